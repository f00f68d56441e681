import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from kinlight.llm import best_fit, common, decontamination, html_text, language_id, quality, sharding, token_counts

ODD = [None, "", " ", "word", "a  b\n\nc ", "x" * 5000, "don't stop", "tab\there   nbsp", "日本語 text", "<|endoftext|> in <|startoftext|>\n<|endoftext|>", "İstanbul ﬁ ½ ²", "\x1c\x85 odd", "é" * 3000, "new\r\nline \n <|endoftext|>x", "á b"]


# --- packing and token counts ------------------------------------------------------------------------------


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 37, 100])
    lengths = [rng.randrange(1, capacity + 1) if seed % 2 else rng.choice([3, 7, capacity]) for _ in range(rng.randrange(1, 200))]
    plan = best_fit.pack_lengths(np.bincount(lengths, minlength=capacity + 1), capacity)
    used, spans = {}, {}
    for rank, n in enumerate(sorted(lengths, reverse=True)):
        first, length, sequence, each, offset = plan[np.searchsorted(plan[:, 0], rank, side="right") - 1].tolist()
        nth = rank - first
        assert length == n
        s, at = sequence + nth // each, offset + nth % each * length
        spans.setdefault(s, []).append((at, at + n))
        used[s] = used.get(s, 0) + n
    for s, parts in spans.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(parts)) and parts[-1][1] <= capacity
    assert sorted(capacity - u for u in used.values()) == plain_best_fit(lengths, capacity)


def test_segment_tree():
    tree, rng, here = best_fit.RoomTree(50), random.Random(1), set()
    for _ in range(400):
        r = rng.randrange(51)
        here ^= {r}
        tree.set(r, int(r in here))
        n = rng.randrange(1, 51)
        assert tree.tightest(n) == min((x for x in here if x >= n), default=-1)


def test_packing_round_trip(docs_of):
    rows = list(enumerate(ODD)) + [(3, "word"), (None, "word"), (90, "of the words " * 6000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = token_counts.load_tokenizer(path)
    got = best_fit.pack(docs_of(rows), path).collect()
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((d or -1, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(n for _, n in parts) <= 4096
    assert len(by) == len(plain_best_fit([w[3] for w in want], 4096))
    assert best_fit.pack(docs_of([]), path).count() == 0


def test_word_ids_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tokenizer, rng = best_fit.WordIds(path), token_counts.load_tokenizer(path), random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice([chr(rng.randrange(256)), rng.choice("abc 'sdtlm've\n\t,.!ÀÉßüµª²¼×÷ "), rng.choice(["<|endoftext|>", "中", "İ", "’"]) if rng.random() < 0.05 else "x"]) for _ in range(rng.randrange(40)))
        assert np.frombuffer(known.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(best_fit, "CACHE_LIMIT", 5)
    path = public_tokenizers.path("word_bpe_49k.json")
    known, tokenizer = best_fit.WordIds(path), token_counts.load_tokenizer(path)
    for i in range(60):
        text = " ".join(f"w{(i * k) % 17}" for k in range(9))
        assert np.frombuffer(known.ids([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(known.now) < 40


def test_token_counts_equal_the_library(docs_of):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" \n\t \x1cab'1!é中") for _ in range(40)) for _ in range(200)]
    texts += ["".join(rng.choice("abcdef ghi\n") for _ in range(400_000)), "z" * 3000, "1" * 700 + " " + "ab" * 400]
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = token_counts.load_tokenizer(path)
    got = sorted(tuple(r) for r in token_counts.count_tokens(docs_of(texts), path, limit=10).collect())
    for (_, n_bytes, n, over), t in zip(got, texts):
        assert (n_bytes, n) == (len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) and over == (n > 10)
    assert token_counts.count_tokens(docs_of([]), path).count() == 0


def test_token_counts_shuffle_nothing(docs_of, capsys):
    docs = docs_of(["some words", None])
    token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).explain()
    assert "Exchange" not in capsys.readouterr().out
    assert token_counts.frequent_pieces(docs_of(["b b a", " b c"] * 3000), most=1, sample=10) == [" b"]


# --- sharding ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000])
def test_permutation(n):
    p = sharding.permuted(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permuted(p, n, inverse=True).tolist() == list(range(n))
    if n == 1000:
        assert (p != np.arange(n)).mean() > 0.98 and sharding.permuted(np.arange(n), n, seed=1).tolist() != p.tolist()
    for row in range(0, n, 97):
        shard, slot = sharding.place_of(row, n)
        assert sharding.row_at(shard, slot, n) == row


def test_shards(docs_of, spark, tmp_path):
    rows = [(i % 90, f"text {i}") for i in range(100)] + [(5, "same"), (5, "same"), (None, None), (3, None)]
    got = sharding.assign_shards(docs_of(rows), shards=7).collect()
    assert len(got) == len(rows)
    sizes = [sum(r.shard == s for r in got) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    key = {(r.doc_id, r.text_crc32, r.size): 0 for r in got}
    assert set(key) == {(d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t in rows}
    again = sharding.assign_shards(docs_of(rows[::-1]).repartition(9), shards=7)
    assert sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in again.collect()) == sorted((r.doc_id or -1, r.text_crc32, r.shard, r.slot) for r in got)
    assert sorted((-1 if d is None else d, c, n, s, k) for d, n, c, s, k in plain_shards(rows, 7)) == sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in got)
    from pyspark.sql import functions as F

    odd = docs_of(rows).withColumns({"shard": F.lit("own"), "_AT_SHARD": F.lit(1), "_row_nth": F.lit(2)})
    sharding.write_shards(odd, str(tmp_path / "s"), shards=7)
    written = spark.read.parquet(str(tmp_path / "s"))
    assert set(written.columns) == {*odd.columns, "shard_"}

    def named(d, t):
        return (-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)

    want = {}
    for d, n, c, s, _ in plain_shards(rows, 7):
        want.setdefault((-1 if d is None else d, c, n), []).append(s)
    found = {}
    for r in written.collect():
        assert r["shard"] == "own"
        found.setdefault(named(r.doc_id, r.text), []).append(r["shard_"])
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert sharding.assign_shards(docs_of([])).count() == 0


def plain_shards(rows, shards):
    """(doc_id, size, crc, shard, slot) by the definition, one row at a time with Python's integers."""
    mask64 = (1 << 64) - 1

    def mixed(x, key):
        z = (x + key) & mask64
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask64
        return z ^ (z >> 31)

    keys = [mixed(i * 0x9E3779B97F4A7C15 & mask64, sharding.SEED) for i in range(1, sharding.ROUNDS + 1)]
    n = len(rows)
    half = 1
    while 4**half < n:
        half += 1

    def walk(x):
        while True:
            left, right = x >> half, x & ((1 << half) - 1)
            for key in keys:
                left, right = right, left ^ (mixed(right, key) & ((1 << half) - 1))
            x = left << half | right
            if x < n:
                return x

    described = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows]
    ordered = sorted(described, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    return [(*r, walk(i) % shards, walk(i) // shards) for i, r in enumerate(ordered)]


# --- quality -----------------------------------------------------------------------------------------------


def test_features_are_of_the_text_alone():
    texts = ["AB cd!", "", "one one two\nthree\nthree", "é à |", " "]
    alone = [quality.features(*arrays([t]))[0] for t in texts]
    assert np.allclose(quality.features(*arrays(texts)), alone)
    f = dict(zip(quality.FEATURES, alone[0]))
    assert f["upper"] == 2 / 6 and f["exclamation"] == 1 / 6 and f["word_length"] == 2.5 and f["upper_words"] == 0.5
    assert not alone[1].any()
    f = dict(zip(quality.FEATURES, alone[2]))
    assert f["distinct_words"] == 3 / 5 and f["same_as_last"] == 2 / 5 and f["distinct_lines"] == 1.0


def arrays(texts):
    return common.buffers(pa.array(texts, pa.string()))


def test_forest_learns_and_flattens():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = quality.fit(x[:2000], y[:2000])
    assert ((forest.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    slow = []
    for row in x[2000:2020]:
        margin = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            margin += forest.leaf[t, node - forest.feature.shape[1]]
        slow.append(1 / (1 + math.exp(-margin)))
    assert np.allclose(slow, forest.scores(x[2000:2020]))
    assert np.ptp(quality.fit(x[:50], np.ones(50)).scores(x)) == 0
    assert quality.fit(np.zeros((0, 5)), np.zeros(0)).scores(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, quality.train(docs, labels)).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50 and (scored.predicted == scored.quality).mean() > 0.95
    assert all((zlib.crc32(str(d).encode()) % 4) == 2 for d in scored.doc_id)


def test_quality_of_odd_rows(docs_of, spark):
    rows = list(enumerate(ODD)) + [(3, "word"), (None, "word")]
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    forest = quality.train(docs_of(rows), labels)
    got = quality.score(docs_of(rows), forest).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.drop_low_quality(docs_of(rows), forest)
    assert kept.columns == docs_of([]).columns and kept.count() == sum(r.predicted for r in got)
    assert quality.score(docs_of([]), forest).count() == 0
    unlearnt = quality.train(docs_of(rows), labels.limit(0))
    assert quality.drop_low_quality(docs_of(rows), unlearnt).count() == len(rows)
    assert {r.score for r in quality.score(docs_of(rows), unlearnt).collect()} == {0.5}


def test_fit_is_the_same_whatever_the_partitions(docs_of, spark):
    rng = random.Random(3)
    rows = [(i % 40, " ".join(rng.choice(["a", "bb", "Ccc", "d!", "9"]) for _ in range(rng.randrange(1, 30)))) for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    one, other = quality.train(docs_of(rows), labels), quality.train(docs_of(rows[::-1]).repartition(7), labels.repartition(3))
    assert one.rows == other.rows <= 40 and one.base == other.base
    assert all((getattr(one, f) == getattr(other, f)).all() for f in ("feature", "threshold", "leaf"))


# --- language ----------------------------------------------------------------------------------------------

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    vocabulary = language_id.load_vocabulary(VOCABULARY)
    rng = np.random.default_rng(2)
    p = rng.random((vocabulary.get_piece_size(), 3)) + 1e-3
    model = language_id.PieceModel(["a", "b", "c"], np.zeros(3), p / p.sum(axis=0))
    scores = language_id.WordScores(VOCABULARY, model)

    def brute(text):
        if not text:
            return np.ones(3)
        total = np.zeros(3)
        for n in range(1, len(text) + 1):
            piece = scores.pieces.get(text[:n])
            if piece is not None:
                total = total + model.probability[piece] * brute(text[n:])
            elif n == 1:
                total = total + language_id.UNKNOWN * brute(text[n:])
        return total

    for word in ["the", "größe", "x中y", "z", "reading"]:
        assert np.allclose(scores.of_texts([[word]])[0], np.log(brute("▁" + word)))
    assert np.allclose(scores.of_texts([["the", "the"], [], ["z"]])[0], 2 * scores.of_texts([["the"]])[0])

    def by_place(text):
        """The same sum in whole numbers of Python, which never run out of range."""
        from fractions import Fraction

        reached = [[Fraction(1)] * 3] + [[Fraction(0)] * 3 for _ in text]
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - scores.longest), end):
                piece = scores.pieces.get(text[start:end])
                row = model.probability[piece] if piece is not None else [language_id.UNKNOWN] * 3 if end - start == 1 else None
                if row is not None:
                    reached[end] = [a + b * Fraction(float(x)) for a, b, x in zip(reached[end], reached[start], row, strict=True)]
            reached[end] = [Fraction(x.numerator * (1 << 4000) // x.denominator, 1 << 4000) for x in reached[end]]
        return [math.log(x.numerator) - math.log(x.denominator) for x in reached[-1]]

    long = ("donaudampfschifffahrtsgesellschaft" * 15)[:500]
    for word in [long, long[:65], long[:64], "東京" * 40]:
        assert np.allclose(scores.of_texts([[word], ["the"]])[0], by_place("▁" + word), rtol=1e-9)
    assert long not in scores.rows and "the" in scores.rows


def test_words_are_letters():
    assert language_id.words_of("½ ②") == language_id.words_of("2² 3³ _ 5") == []
    assert language_id.words_of("Größe x²y a_b 中文½字 don't") == ["größe", "x", "y", "a", "b", "中文", "字", "don", "t"]
    assert language_id.words_of("a" * 100_000) == ["a" * 100_000]


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, VOCABULARY, language_id.train(docs, VOCABULARY)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got.lang == got.lang_pred).mean() > 0.98
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in got.doc_id)


def test_languages_of_odd_rows(docs_of):
    rows = list(enumerate(ODD)) + [(50, "123 !!"), (None, "the word"), (51, "a" * 500), (52, "½ ②"), (53, "2² 3³"), (54, "the word " * 40_000), (55, "b" * 30_000)]
    docs = docs_of(rows)
    model = language_id.train(docs, VOCABULARY)
    got = {r.doc_id: r for r in language_id.identify(docs, VOCABULARY, model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[50].lang_pred == "und" and got[50].score == 0
    assert got[52].lang_pred == got[53].lang_pred == "und" and got[54].lang_pred == got[55].lang_pred == "en"
    assert got[3].lang_pred == got[51].lang_pred == got[None].lang_pred == "en" and got[3].score == 1
    none = language_id.train(docs.limit(0), VOCABULARY)
    assert {r.lang_pred for r in language_id.identify(docs, VOCABULARY, none).collect()} == {"und"}


# --- decontamination ---------------------------------------------------------------------------------------


def plain_shingles(text, k=5):
    words = [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split(" ") if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("seed", range(2))
def test_containment_matches_brute_force(docs_of, spark, seed):
    rng = random.Random(seed)
    items = [(i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([1, 3, 5, 6, 9, 20, 60])))) for i in range(25)] + [(80, None), (81, ""), (None, "w1 w2"), (0, "x y z"), (82, "!!")]
    rows = []
    for d in range(60):
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(60))]
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(3)):
            if item:
                item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(words) + 1)
        rows.append((d, ", ".join(words[:at]) + " " + " ".join(item).upper() + "\n" + " ".join(words[at:])))
    rows += [(100, None), (101, ""), (None, items[3][1]), (5, items[4][1]), (102, items[0][1]), (103, items[1][1] + " more"), (104, "x y z"), (105, f"a long one {'b ' * 9} X, y; Z and more {'c ' * 9}"), (106, "x y"), (107, "xx y z")]
    want = {}
    for d, t in rows:
        for i, text in items:
            q = plain_shingles(text)
            s = plain_shingles(t, min(5, max((len(x.split()) for x in q), default=5)))
            if d is not None and i is not None and q and len(s & q) / len(q) >= 0.8:
                want[d, i] = max(want.get((d, i), 0), len(s & q) / len(q))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontamination.find_contained(docs_of(rows), benchmark).collect()}
    assert got == want and len(want) > 20 and (105, 0) in got and not got.keys() & {(106, 0), (107, 0)}
    with pytest.MonkeyPatch.context() as few:
        few.setattr(decontamination, "BROADCAST_SKETCHES", 3)
        assert {(r.doc_id, r.item_id): r.containment for r in decontamination.find_contained(docs_of(rows), benchmark).collect()} == want
    left = decontamination.drop_contaminated(docs_of(rows), benchmark)
    assert left.columns == docs_of([]).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == sorted(-1 if d is None else d for d, _ in rows if d is None or d not in {x for x, _ in want})
    assert decontamination.find_contained(docs_of([]), benchmark).count() == 0
    assert decontamination.find_contained(docs_of(rows), benchmark.limit(0)).count() == 0


def test_decontamination_is_native(docs_of, spark):
    found = decontamination.find_contained(docs_of(["a b c"]), spark.createDataFrame([(1, "a b c")], "item_id long, text string"))
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Pandas", "Arrow"))


# --- pages -------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p><article>no</article>"</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a>About</a></li></ul></nav>
<!-- <p>hidden</p> --><div class="cookie-notice">We use cookies and you should know about them at length.</div>
<article><header><h1>A &amp; B</h1><p>By <a>Someone</a></p></header><p>First   part<br>second <b>bo</b>ld&nbsp;word.<p>Short.
<div class="ad">Buy now</div><aside>Aside</aside><form>Name <input><button>Go</button></form><p title="a > b">Last &eacute; &#233; &lt;tag&gt;</p>
<section id="comments"><p>A comment by a reader that goes on for quite some time.</p></section></article>
<div class="sidebar">More</div><footer>&copy; Someone</footer></body></html>"""


def test_page():
    assert html_text.main_text(PAGE) == "A & B First part second bold word. Short. Last é é <tag>"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p", ""), ("<article>cut off &am", "cut off &am"), ("<article>a<!-- never ends", "a"), ("<article>x<script>never ends", "x"), ("<article>1 < 2 <> 3</article>", "1 < 2 <> 3"), ("<article><p>one<p>two</article>", "one two"), ("<main>m</main>", "m"), ("<article>" + "<div>" * 3000 + "deep", "deep"), ('<article><a href="x>y">in</a>side</article>', "inside"), ("<ARTICLE>up</ARTICLE>", "up"), ("<article> \n </article>", "")])
def test_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_page_without_article():
    prose = "This is a paragraph of prose with quite a number of words in it that reads like an article does."
    page = f"<body><div class='menu'><a>One</a> <a>Two</a></div><div><a>x</a></div><h2>The title</h2><p>{prose}</p><p>Short one.</p><p>{prose}</p><div><a>y</a> <a>z</a></div></body>"
    assert html_text.main_text(page) == f"The title {prose} Short one. {prose}"


PROSE = "This is a paragraph of prose with quite a number of words in it that reads like an article does."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id='all'><div><a>Home</a> <a>Shop</a></div><article><h1>Title here</h1><p>{PROSE}<p>Short.</article></form>", f"Title here {PROSE} Short."),
        (f"<body><form id='all'><div><a>Home</a> <a>Shop</a></div><h1>Title here</h1><p>{PROSE}<p>{PROSE}</form>", f"Title here {PROSE} {PROSE}"),
        (f"<article><p>{PROSE}<p class='share-price'>{PROSE}<p class='share'>Tell a friend</p><p>End.</article>", f"{PROSE} {PROSE} End."),
        (f"<body><p>{PROSE}<ul><li>one two three four five<li>six seven eight nine<li>ten eleven</ul><p>{PROSE}", f"{PROSE} one two three four five six seven eight nine ten eleven {PROSE}"),
        (f"<aside><article><p>{PROSE}</article></aside><article><p>{PROSE} End.</article>", f"{PROSE} End."),
        (f"<article><p>{PROSE}<ul><li><a>Read this</a><li><a>And this one</a></ul><p>{PROSE}</article>", f"{PROSE} {PROSE}"),
        (f"<article><p>{PROSE}</article><div class='comments'><p>{PROSE}<p>{PROSE}</div>", PROSE),
    ],
)
def test_layouts(page, text):
    assert html_text.main_text(page) == text


def test_tree_fits_its_table():
    rows = html_text.labelled()
    table = np.array(rows, float)
    tree = html_text.grow(rows)
    assert (html_text.classify(tree, table[:, :-1]) == (table[:, -1] > 0.5)).all() and len(tree) < 60
    # no element or name settles a label by itself
    for i, name in enumerate(html_text.FEATURES):
        if name in ("article", "form", "heading", "header"):
            assert 0 < table[table[:, i] > 0, -1].mean() < 1, name


def pages_of_sf():
    import duckdb

    return [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.1/pages.parquet' ORDER BY page_id").fetchall()]


def test_words_and_links_decide():
    draw, tree = np.random.default_rng(5), html_text.grow(html_text.labelled())
    x = np.concatenate([html_text.describe(html_text.blocks(p)) for p in pages_of_sf()[::10]])
    y = x.copy()
    for i in range(0, 8, 2):
        y[:, i], y[:, i + 1] = draw.integers(1, 80, len(x)), draw.random(len(x))
    assert (html_text.classify(tree, x) != html_text.classify(tree, y)).mean() > 0.1


def test_precision_and_recall_by_words_on_pages():
    """The truth is read from the pages by patterns: what is between the article's tags."""
    import html
    from collections import Counter

    tree, shared, found, wanted = html_text.grow(html_text.labelled()), 0, 0, 0
    for page in pages_of_sf():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", page, re.S)[1]
        truth = Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())
        got = Counter(html_text.main_text(page, tree).split())
        shared, found, wanted = shared + (truth & got).total(), found + got.total(), wanted + truth.total()
    assert shared / found > 0.99 and shared / wanted > 0.99


def test_long_page():
    page = "<nav><a>Home</a></nav><article>" + f"<p>{PROSE} " * 30_000 + "</article>"
    assert html_text.main_text(page) == " ".join([PROSE] * 30_000)


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (1, None, None, 5), (None, "v", "<article>é</article>", 5)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in html_text.extract(df).collect()))
    assert got == [(-1, "v", "é", 1), (1, "", "", 0), (1, "u", html_text.main_text(PAGE), len(html_text.main_text(PAGE)))]
    assert html_text.extract(df.limit(0)).count() == 0
