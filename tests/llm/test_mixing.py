import collections
import random
import re

import numpy as np
import pytest

from kinlight.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights, share=1.5, most=2):
    """Water filling by bisection on what one unit of weight gets."""
    low, high = 0.0, most * max(sizes) / min(weights) + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(most * n, mid * w) for n, w in zip(sizes, weights)) < share * sum(sizes) else (low, mid)
    return [min(most * n, high * w) for n, w in zip(sizes, weights)]


@pytest.mark.parametrize("seed", range(20))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, rng.randrange(1000), rng.randrange(100_000)]) for _ in range(rng.randrange(1, 12))]
    sizes[0] += 5
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert got == pytest.approx(plain_targets(sizes, weights), rel=1e-6, abs=1e-6)
    assert mixing.targets([0, 0], [5, 2]) == [0, 0] and mixing.targets([], []) == []


@pytest.mark.parametrize("size,target", [(1, 2.0), (511, 700.0), (512, 512.0), (513, 514.4), (5000, 1.0), (5000, 4999.0), (70_001, 123_456.7), (70_001, 140_002.0), (9, 0.0), (0, 0.0)])
def test_takes_add_up_to_the_target(size, target):
    for seed in range(30):
        source = mixing.Source(0, "s", size, target, seed)
        epoch, block, words = source.block_of(np.arange(source.takes))
        held = np.minimum(words, size - block * mixing.BLOCK)
        assert held.sum() == round(target) and (held > 0).all()
        count = np.bincount(block, minlength=source.blocks)
        assert len(count) == source.blocks and (count >= target // max(size, 1)).all() and (count <= np.ceil(target / max(size, 1))).all()


def test_shards_draw_the_same_counts_apart_and_together():
    takes = np.array([1000, 50_000, 0, 7])
    whole = list(mixing.dealt(takes, 13, 0, 13, 5))
    assert [s for s, _, _ in whole] == list(range(13))
    assert (sum(c for _, _, c in whole) == takes).all()
    apart = [row for a in range(13) for row in mixing.dealt(takes, 13, a, a + 1, 5)]
    assert all((f == g).all() and (c == d).all() for (_, f, c), (_, g, d) in zip(whole, apart))
    assert (np.cumsum([c for _, _, c in whole], axis=0)[:-1] == np.array([f for _, f, _ in whole[1:]])).all()
    draws = np.array([[c[1] for _, _, c in mixing.dealt(takes, 10, 0, 10, s)] for s in range(300)])
    assert abs(draws.mean(0) - 5000).max() < 15 and 60 < draws.std(0).mean() < 75


def documents(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        source = rng.choice(["b", "a", "hot", "hot", "hot", None, "", "é"])
        n = rng.choice([0, 1, 3, 40, 700, 3000])
        rows.append((rng.choice([i, i, None, 7]), rng.choice([None, ""]) if not n else "\n".join(f"w{i}.{k}" for k in range(n)), source))
    return [*rows, *rows[:5], (500, "none " * 20, "only")]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, block int, row string")


def test_whole_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 20)
    rows = documents(1)
    mixed = mixing.mix(table(spark, rows).repartition(5))
    got = mixed.taken().collect()
    size_of = lambda t: len(WORD.findall(t or ""))
    by = collections.Counter()
    for _, t, s in rows:
        by[s] += size_of(t)
    names = sorted((s for s in by if s is not None)) + [None]
    targets = dict(zip(names, mixing.targets([by[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    want = sorted((d if d is not None else -1, size_of(t), by[s], targets[s]) for d, t, s in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.source_size, r.target) for r in got) == want
    assert all(r.taken <= 2 * r.size for r in got)
    words = collections.Counter()
    for r in got:
        words[r.source_size, r.target] += r.taken
    many = collections.Counter((by[s], targets[s]) for s in names)
    assert {k: v for k, v in words.items()} == {k: round(k[1]) * many[k] for k in words}
    again = mixing.mix(table(spark, rows[::-1]).repartition(2)).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))

    spans = mixed.spans().collect()
    assert len({s.shard for s in spans}) > 3
    totals = collections.Counter()
    for s in spans:
        totals[s.doc_id] += s.n_words
    held = collections.Counter()
    for r in got:
        held[r.doc_id] += r.taken
    assert totals == +held
    texts = {(r.shard, r.slot): r.text.split(" ") for r in mixed.texts(table(spark, rows)).collect()}
    text_of = collections.defaultdict(set)
    for d, t, _ in rows:
        text_of[d].add(tuple(WORD.findall(t or "")))
    parts = collections.defaultdict(list)
    for s in spans:
        parts[s.shard, s.slot].append(s)
    assert parts.keys() == texts.keys()
    for key, found in parts.items():
        found.sort(key=lambda s: s.place)
        assert sum(s.n_words for s in found) == len(texts[key]) and len({s.source_no for s in found}) == 1
        at = 0
        for s in found:
            assert s.place == at and any(tuple(texts[key][at : at + s.n_words]) == t[s.from_word : s.from_word + s.n_words] for t in text_of[s.doc_id])
            at += s.n_words
    for shard in {k for k, _ in parts}:
        assert sorted(slot for k, slot in parts if k == shard) == list(range(sum(k == shard for k, _ in parts)))


def test_odd_tables(spark):
    assert mixing.mix(table(spark, [])).taken().count() == 0
    got = mixing.mix(table(spark, [(1, None, "a"), (1, None, "a"), (2, " ", None)])).taken().collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = "word " * 1_000_000
    (row,) = mixing.mix(table(spark, [(1, long, "a")])).taken().collect()
    assert tuple(row) == (1, 1_000_000, 1_000_000, 1_500_000.0, 1_500_000)
