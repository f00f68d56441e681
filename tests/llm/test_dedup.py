import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlight.llm import common, exact_dedup, simhash, substring_dedup

ODD = [None, "", " ", "a", "a  b", "a\tb", "a b", " a b", "é" * 3000, "x " * 40000, "x\n" * 40000, "a", "日本 語", None]


def norm(t):
    return re.sub(r"[ \t-\r]+", " ", t or "")


def arrays(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return data, np.cumsum([0, *(len(t.encode()) for t in texts)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=" \t\nab\x0bé", max_size=12), max_size=8))
def test_white_space_and_words(texts):
    data, offsets = arrays(texts)
    out, ends = common.collapse_white(data, offsets)
    assert [out[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])] == [norm(t) for t in texts]
    starts, stops, first = common.word_bounds(data, offsets)
    words = [[data[starts[w] : stops[w]].tobytes().decode() for w in range(a, b)] for a, b in zip(first, first[1:])]
    assert words == [[w for w in norm(t).split(" ") if w] for t in texts]
    h = common.range_hashes(data, starts, stops)
    flat = [w for t in words for w in t]
    assert len(set(h.tolist())) == len(set(flat))


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000), st.integers(0, 5000))
def test_fingerprints_compose(raw, at):
    at = min(at, len(raw))

    def of(part):
        h = exact_dedup.hash_documents(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0]
        return len(part), int(h[0]), int(h[1])

    assert exact_dedup.combine(of(raw[:at]), of(raw[at:])) == of(raw)
    want = [0, 0]
    for byte in raw:
        want = [(v * r + byte + 1) % p for v, r, p in zip(want, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert of(raw)[1:] == tuple(want)


def groups(rows):
    by = {}
    for i, t in rows:
        by.setdefault(norm(t), []).append(i)
    return by


@pytest.mark.parametrize("huge", [exact_dedup.HUGE_BYTES, 500])
def test_exact_groups(docs_of, huge):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "b"), (40, "a\x0b\nb")]
    by = groups(rows)
    got = exact_dedup.exact_dedup(docs_of(rows), huge_bytes=huge).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = next(v for k, v in by.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256 and r.doc_id in v)
        assert (r.keep_id, r.group_size) == (min(ids), len(ids))
    assert sum(r.kept for r in got) == len(by)


def test_exact_keeps_one_row_each(docs_of):
    rows = list(enumerate(ODD)) + [(3, "a"), (3, "b"), (None, "z"), (None, "z"), (None, "a")]
    left = exact_dedup.drop_exact_duplicates(docs_of(rows))
    assert left.columns == docs_of([]).columns
    assert sorted(norm(r.text) for r in left.collect()) == sorted(groups(rows))


def test_rows_without_ids_are_compared(docs_of, spark):
    """Rows without an id that share a fingerprint, but not a text, are told apart, as all others."""
    docs = docs_of([(None, "aa"), (None, "ab"), (None, "aa"), (4, "ab"), (None, "ac"), (None, "ac")])
    rows = docs.select("doc_id", "text")
    members = rows.distinct().select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit(2).cast("long").alias("n_bytes"), F.lit(1).cast("long").alias("fingerprint"), F.lit(4).cast("long").alias("keep_id"))
    checked = exact_dedup._verified(rows, members).collect()
    assert sorted((r.doc_id is None, r.equal) for r in checked) == [(False, True), (True, False), (True, False), (True, True)]
    got = exact_dedup.exact_dedup(docs).collect()
    assert sorted((r.group_size, r.keep_id is None, r.kept) for r in got) == [(2, False, False), (2, False, True), (2, True, False), (2, True, False), (2, True, True), (2, True, True)]


def test_exact_when_fingerprints_collide(docs_of, monkeypatch, spark):
    from pyspark.sql import functions as F

    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda docs, huge: real(docs, huge).withColumns({"fingerprint": F.lit(1).cast("long"), "n_bytes": F.lit(1).cast("long")}))
    rows = [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs_of(rows)).collect()}
    assert got == {0: (0, 2, True), 1: (1, 2, True), 2: (0, 2, False), 3: (3, 1, True), 4: (1, 2, False)}


def test_nothing_to_deduplicate(docs_of):
    assert exact_dedup.exact_dedup(docs_of([])).count() == 0
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert substring_dedup.remove_repeats(docs_of([])).count() == 0


# --- SimHash -----------------------------------------------------------------------------------------------


def plain_simhash(text):
    words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)][: len(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def components(words, ids, radius):
    root = list(range(len(words)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(words)):
        for j in range(i):
            if (words[i] ^ words[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(words))]


def near_texts(seed):
    rng = random.Random(seed)
    out = [t for t in ODD]
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 200))]
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "Other"
            out.append(" ".join(copy))
    return out


def test_simhash_matches_brute_force(docs_of):
    texts = near_texts(1)
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, "and another text of the same id")]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    want = [plain_simhash(t) for _, t in rows]
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((d, f"{w:016x}") for (d, _), w in zip(rows, want))
    named = dict(zip([(d, f"{w:016x}") for (d, _), w in zip(rows, want)], components(want, [d for d, _ in rows], 4)))
    assert all(named[r.doc_id, r.fingerprint] == r.component_id for r in got)


@pytest.mark.parametrize(("blocks", "limit"), [(1, 4096), (2, 4096), (2, 3), (4, 4096)])
def test_links_connect_what_brute_force_connects(spark, blocks, limit):
    rng = random.Random(blocks)
    words = [rng.getrandbits(64) for _ in range(15)]
    for w in words[:12]:
        for _ in range(12):
            x = w
            for b in rng.sample(range(64), rng.randrange(7)):
                x ^= 1 << b
            words.append(x)
    words = list(dict.fromkeys(words))
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = simhash.near_links(spark.createDataFrame([(w,) for w in signed], "fp long"), 4, blocks, limit).collect()
    root = {w: w for w in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4
        root[find(r.a)] = find(r.b)
    want = components(words, list(range(len(words))), 4)
    mine = [find(w) for w in signed]
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_near_keeps_one_of_each_component(docs_of):
    texts = near_texts(2)
    rows = list(enumerate(texts)) + [(0, None), (None, "only one like this"), (None, "only one like this")]
    found = simhash.near_duplicates(docs_of(rows)).collect()
    left = simhash.drop_near_duplicates(docs_of(rows)).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left) == sorted({r.component_id if r.component_id is not None else -1 for r in found})


# --- substrings --------------------------------------------------------------------------------------------


def plain_removal(rows, window=13):
    words = [[w for w in re.split(r"[ \t-\r]+", t or "") if w] for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d if d is not None else -1, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def passages(seed, n=40):
    rng = random.Random(seed)
    shared = [[f"s{k}x{i}" for i in range(rng.randrange(10, 40))] for k in range(6)] + [["the"] * 30]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rng.randrange(6)):
            words += [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(30))]
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            words += s[a : a + rng.randrange(40)]
        rows.append((d, rng.choice([" ", "\n", "  "]).join(words)))
    rng.shuffle(rows)
    return rows + [(7, "same id"), (None, rows[0][1]), (n, None), (n + 1, ""), (n + 2, "the " * 60), (n + 3, rows[1][1])]


@pytest.mark.parametrize(("seed", "limit", "most_bits", "frequent", "hash_bits"), [(1, 1 << 18, 1 << 26, 10_000, 64), (2, 5, 1 << 26, 10_000, 64), (3, 1 << 18, 1 << 10, 10_000, 64), (4, 1 << 18, 1 << 26, 3, 64), (5, 5, 1 << 10, 3, 64), (6, 1 << 18, 1 << 26, 10_000, 3), (7, 300, 1 << 26, 10_000, 1), (8, 1 << 18, 1 << 26, 3, 2)])
def test_removal_matches_brute_force(docs_of, monkeypatch, seed, limit, most_bits, frequent, hash_bits):
    """With few bits of the hashes, most windows under one hash differ: nothing may be cut for that."""
    real = substring_dedup.repeated_spans
    monkeypatch.setattr(substring_dedup, "repeated_spans", lambda docs, window, anchor: real(docs, window, anchor, limit, frequent, hash_bits))
    monkeypatch.setattr(substring_dedup, "MOST_FILTER_BITS", most_bits)
    rows = passages(seed)
    got = substring_dedup.remove_repeats(docs_of(rows)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed, r.kept_text) for r in got) == plain_removal(rows)


def test_parts_of_a_filter_are_the_filter():
    rng = np.random.default_rng(1)
    shared, others, bits = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(0, 1 << 63, 5000).astype(np.uint64), 1 << 13
    passed = []
    for size in (bits, 1 << 10):
        found = np.zeros(5300, np.int64)
        for nth in range(bits // size):
            flags = np.zeros(size // 64, np.int64)
            batch = pa.RecordBatch.from_arrays([pa.array(shared.view(np.int64))], ["anchor"])
            (words,) = substring_dedup._filter_words(bits, nth * size, (nth + 1) * size)(iter([batch]))
            flags[words.column("at").to_numpy()] = words.column("word").to_numpy()
            found += substring_dedup._has(flags.view(np.uint8), np.concatenate((shared, others)), bits, nth)
        passed.append(found)
    assert (passed[0] == passed[1]).all() and passed[0].max() == 1 and passed[0][:300].all() and passed[0][300:].mean() < 0.06


def test_windows_of_equal_hashes_and_other_words_stay():
    texts = [" ".join(f"{c}{i}" for i in range(13)) for c in "abcab"] + ["short", ""]
    data, offsets = arrays(texts)
    begin, end = offsets[:5], offsets[1:6]
    one = np.zeros(5, np.uint64)
    found = substring_dedup._repeated(np.zeros(5, np.int64), np.array([3, 1, 9, 7, 1]), data, begin, end, one)
    assert sorted(found.tolist()) == [3]


def test_removal_over_slices(docs_of, monkeypatch):
    rows = passages(4, 12)
    data, offsets = arrays([t or "" for _, t in rows])

    def relative(d, o):
        (of, word, least, place), (_, _, first) = substring_dedup.anchored_windows(d, o, 13, 5)
        return word - first[of], least, place - first[of]

    whole = relative(data, offsets)
    parts = [relative(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in common.runs_of_documents(offsets, 300)]
    for k in range(3):
        assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()
