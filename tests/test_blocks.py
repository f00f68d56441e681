"""Pruned similarity joins: the same pairs as brute force, from fewer products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.operators import blocks, vectors


def clustered(seed, groups, size, d=24, spread=0.25):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (groups, d))
    v = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], size, 0) + rng.normal(0, spread / np.sqrt(d), (groups * size, d))
    return v / np.linalg.norm(v, axis=1)[:, None]


def table(spark, v, label=lambda i: i % 3):
    return spark.createDataFrame([(i, x, label(i)) for i, x in enumerate(v.tolist())], "face_id long, vector array<double>, label int").repartition(4)


def pairs_of(v, least):
    sim = v @ v.T
    return {(i, j) for i, j in zip(*np.nonzero(sim >= least), strict=True) if i < j}


def multiplied(found):
    """Products of two rows that the pairs of blocks ask for."""
    sides = found.sides().groupBy(*blocks.PAIR).agg(F.sum((F.col("side") == 0).cast("long")).alias("p"), F.sum((F.col("side") == 1).cast("long")).alias("q"))
    return sum(r.p * (r.q or r.p) for r in sides.collect())


def test_few_products_where_vectors_cluster(spark):
    v = clustered(1, 40, 40)
    df = table(spark, v)
    found = blocks.blocks_of(df, 0.8, "face_id", "vector", block=32)
    assert multiplied(found) < 0.2 * len(v) ** 2 / 2
    assert max(r["count"] for r in found.rows.groupBy("group", "cell", "block").count().collect()) <= 64
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.8, block=32).collect()} == pairs_of(v, 0.8)


@pytest.mark.parametrize("least", [-0.2, 0.0, 0.3, 0.95])
def test_same_pairs_as_brute_force(spark, least):
    rng = np.random.default_rng(7)
    v = np.concatenate([clustered(2, 5, 20, 6), rng.normal(0, 1, (60, 6)), np.zeros((3, 6)), np.repeat(rng.normal(0, 2, (1, 6)), 50, 0), clustered(3, 2, 20, 6) * 3])
    got = [(r.a, r.b) for r in vectors.similar_pairs(table(spark, v), least, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs_of(v, least)


def test_neighbours_and_groups(spark):
    v = clustered(4, 12, 30)
    df = table(spark, v, lambda i: 0 if i % 2 else i % 5)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    want = {(i, n + 1): int(j) for i in range(len(v)) for n, j in enumerate(np.lexsort((np.arange(len(v)), -sim[i]))[:4]) if sim[i, j] >= 0.7}
    assert {(r.src, r["rank"]): r.dst for r in vectors.knn(df, 4, 0.7, block=16).collect()} == want
    labels = [0 if i % 2 else i % 5 for i in range(len(v))]
    inside = {(i, j) for i, j in pairs_of(v, 0.7) if labels[i] == labels[j]}
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.7, within="label", block=16).collect()} == inside


def test_equal_vectors_fill_many_blocks(spark):
    v = np.concatenate([np.repeat(clustered(5, 1, 1), 200, 0), clustered(6, 3, 20)])
    found = blocks.blocks_of(table(spark, v), 0.9, "face_id", "vector", block=16)
    assert max(r["count"] for r in found.rows.groupBy("group", "cell", "block").count().collect()) <= 32
    assert vectors.similar_pairs(table(spark, v), 0.9, block=16).count() == len(pairs_of(v, 0.9))


def test_bound_of_two_blocks():
    rng = np.random.default_rng(8)
    v = rng.normal(0, 1, (400, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    pivots = v[:2]
    to = np.arccos(np.clip(v @ pivots.T, -1, 1))
    for _ in range(200):
        a, b = rng.integers(0, 400, 5), rng.integers(0, 400, 5)
        least = blocks.least_angle(np.array([np.arccos(np.clip(pivots[0] @ pivots[1], -1, 1))]), to[a, 0].min(), to[a, 0].max(), to[b, 1].min(), to[b, 1].max())
        assert least[0] <= np.arccos(np.clip(v[a] @ v[b].T, -1, 1)).min() + 1e-9


def test_copies_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 50)
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(3000, 16))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "face_id long, vector array<double>")
    copies = blocks.blocks_of(df, 0.3, "face_id", "vector").sides().groupBy("id").count()
    assert copies.count() == 3000 and copies.agg({"count": "max"}).first()[0] <= 5 * blocks.GRID
