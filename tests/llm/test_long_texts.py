"""Texts longer than a slice are worked on in pieces: the results of the whole, in bounded memory."""

import random
import subprocess
import sys

import numpy as np
import pytest

from kinlight.llm import common, quality, simhash, substring_dedup

TEXTS = [
    "",
    " \n ",
    "one",
    "x" * 900,
    "word " * 150 + "\n" * 40,
    "\n \t a b  c\n\nd " * 60,
    "Über ALLES! (na) " * 50 + "y" * 300 + " end." + " " * 200,
    " ".join(random.Random(3).choices(["alpha", "BETA", "7", "gamma;", "ß"], k=800)),
    "a\nb\n" * 200,
    "\n" * 500,
    "tail " * 100 + "z" * 400,
]


def arrays(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


@pytest.mark.parametrize("limit", [1, 7, 64, 200])
@pytest.mark.parametrize("overlap", [0, 3, 12])
def test_pieces_hold_each_run_of_words_once(limit, overlap):
    for text in TEXTS:
        raw, _ = arrays(text)
        words = [w.encode() for w in text.split()]
        runs = []
        for before, piece in common.pieces_of_words(raw, overlap, limit):
            own = piece.tobytes().split()
            assert own == words[before : before + len(own)]
            runs += [(before + i, tuple(own[i : i + overlap + 1])) for i in range(len(own) - overlap)]
        assert runs == [(i, tuple(words[i : i + overlap + 1])) for i in range(len(words) - overlap)]
        assert b"".join(p.tobytes() for p in common.tiles(raw, limit)) == raw.tobytes()


@pytest.mark.parametrize("limit", [1, 50, 333])
def test_results_are_those_of_the_whole(monkeypatch, limit):
    whole = [(simhash.fingerprint_texts(*arrays(t)), np.sort(simhash.shingle_sets(*arrays(t))[0]), quality.features(*arrays(t))) for t in TEXTS]
    for name in ("pieces_of_words", "tiles"):
        real = getattr(common, name)
        monkeypatch.setattr(common, name, lambda *a, real=real: real(*a, limit))
    monkeypatch.setattr(common, "SLICE_BYTES", limit)
    for text, (fp, shingles, x) in zip(TEXTS, whole, strict=True):
        assert simhash.fingerprint_texts(*arrays(text)).tolist() == fp.tolist()
        assert np.sort(simhash.shingle_sets(*arrays(text))[0]).tolist() == shingles.tolist()
        np.testing.assert_allclose(quality.features(*arrays(text)), x, rtol=1e-12, atol=1e-12)


def test_cut_texts_are_those_of_the_whole(spark, monkeypatch):
    rng = random.Random(5)
    passages = [" ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(14, 60))) for _ in range(6)]
    rows = [(i, "\n ".join(rng.choices(passages, k=rng.randrange(1, 9))) + f"  own{i} ") for i in range(12)] + [(12, None), (13, " "), (None, passages[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, substring_dedup.remove_repeats(docs).collect()), key=str)
    data, offsets = substring_dedup.common.buffers(docs.toArrow().column("text"))
    ranges = np.array([[3, 16], [40, 41]])
    for i in range(12):
        part = data[offsets[i] : offsets[i + 1]]
        n = len(part.tobytes().split())
        some = ranges[ranges[:, 1] <= n]
        kept = b" ".join(w for k, w in enumerate(part.tobytes().split()) if not any(a <= k < b for a, b in some))
        monkeypatch.setattr(common, "SLICE_BYTES", 40)
        joined, _, total, removed = substring_dedup._cut_long(part, some)
        assert (joined.tobytes(), total.tolist(), removed.tolist()) == (kept, [n], [int((some[:, 1] - some[:, 0]).sum())])
    # windows of pieces are those of the whole, each once
    batch = docs.filter("doc_id is not null").toArrow().combine_chunks().to_batches()[0]
    found = []
    for size in (1 << 20, 40):
        monkeypatch.setattr(common, "SLICE_BYTES", size)
        real = common.pieces_of_words
        monkeypatch.setattr(common, "pieces_of_words", lambda d, o, limit=None, size=size, real=real: real(d, o, limit or size))
        seen = []
        for i, before, d, o in substring_dedup._slices(batch, 13) if size == 40 else substring_dedup._slices(batch, 13):
            (of, word, least, place), (starts, ends, first) = substring_dedup.anchored_windows(d, o, 13, 5)
            seen += [(i + int(a), int(w - first[a]) + before, int(h), d[starts[w] : ends[w + 12]].tobytes()) for a, w, h in zip(of, word, least, strict=True)]
        found.append(sorted(seen))
    assert found[0] == found[1] and found[0] and whole


@pytest.mark.parametrize(("call", "most"), [("simhash.fingerprint_texts(raw, at)", 400), ("quality.features(raw, at)", 900), ("sum(len(substring_dedup.anchored_windows(d, o, 13, 5)[0][0]) for _, _, d, o in substring_dedup._slices(batch, 13))", 400)])
def test_memory_of_a_text_of_64_mb(call, most):
    code = f"""
import resource, numpy as np, pyarrow as pa
from kinlight.llm import quality, simhash, substring_dedup
text = ("lorem Ipsum dolor sit amet, consectetur\\n" * 5 * (1 << 20))[: 64 << 20]
raw = np.frombuffer(text.encode(), np.uint8); at = np.array([0, len(raw)])
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{call}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert float(out.stdout) < most, out.stdout
