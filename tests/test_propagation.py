"""Label propagation by colours: one task a component, or all tasks for all of them, with the same labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.operators import clustering


def graph(seed, parts=3, size=14):
    draw, edges = random.Random(seed), {}
    for p in range(parts):
        for v in range(1, size):
            for u in {draw.randrange(v), draw.randrange(v), v - 1}:
                edges[p * 100 + v, p * 100 + u] = draw.choice([0.4, 0.6, 0.9, 0.35])
    return [(a, b, w) for (x, y), w in edges.items() for a, b in ((x, y), (y, x))]


def test_colouring_is_proper_and_the_greedy_one(spark):
    edges = graph(1) + [(0, 500 + i, 1.0) for i in range(40)] + [(500 + i, 0, 1.0) for i in range(40)]
    df = spark.createDataFrame([e[:2] for e in edges], "src long, dst long")
    found = {r.node: r.colour for r in clustering.colours_of(df, 5, one_task=0).collect()}
    assert all(found[a] != found[b] for a, b, _ in edges) and found == {r.node: r.colour for r in clustering.colours_of(df, 5).collect()}


@pytest.mark.parametrize("linked", [False, True])
def test_one_task_or_all(spark, linked):
    edges = graph(3)
    must = [(2, 9), (9, 104), (300, 301)] if linked else None
    nodes = spark.createDataFrame([(v,) for v in sorted({e[0] for e in edges} | {300, 301, 302})], "node long")
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    links = spark.createDataFrame(must, "a long, b long") if must else None
    alone, all_ = ({r.node: r.label for r in clustering.chinese_whispers(nodes, df.repartition(k), links, 7, one_task=n).collect()} for n, k in ((10_000, 3), (0, 2)))
    assert alone == all_ and len(alone) == nodes.count() and 1 < len(set(alone.values())) < len(alone)
    for a, b in must or []:
        assert alone[a] == alone[b]
    assert all(v in group and min(group) == v for v in set(alone.values()) for group in [{n for n, x in alone.items() if x == v}])


def test_arrays_as_one_by_one():
    rng = np.random.default_rng(3)
    for n, m in ((3, 4), (40, 300), (200, 900)):
        ends = rng.integers(0, n, (m, 2)) * 7 + 5
        ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
        weight = rng.integers(1, 6, len(ends)) / 8
        must = [(5, 12), (12, 5 + 7 * (n - 1)), (5, 10_000)]
        nodes = np.unique(np.append(ends, [x for pair in must for x in pair]))
        rank = rng.integers(-5, 5, len(nodes))
        edges: dict = {}
        for (a, b), w in zip(ends.tolist(), weight.tolist(), strict=True):
            edges.setdefault(a, {})[b] = w
        want = clustering.propagate(edges, must, {v: (r, v) for v, r in zip(nodes.tolist(), rank.tolist(), strict=True)}, 9)
        got = clustering.propagate_arrays(ends[:, 0], ends[:, 1], weight, must, nodes, rank, 9)
        assert dict(zip(nodes.tolist(), got.tolist(), strict=True)) == want


def test_a_component_of_600_000_edges_needs_no_job_a_colour(spark, monkeypatch):
    monkeypatch.setattr(clustering, "_by_colours", lambda *_: pytest.fail("one job a colour"))
    nodes = spark.range(6000).withColumnRenamed("id", "node")
    near = nodes.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(50))).alias("by")).select("src", ((F.col("src") + F.col("by")) % 6000).alias("dst"), (1.0 / F.col("by")).alias("weight"))
    both = near.union(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    assert clustering.chinese_whispers(nodes, both).count() == 6000
