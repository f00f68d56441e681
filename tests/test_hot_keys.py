"""Half of all rows in one key: the same results, with the key dealt to many tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.operators import duplicates, people, vectors
from kinlight.plans import lineage


@pytest.fixture
def hot(spark, monkeypatch):
    monkeypatch.setattr(lineage, "LEAST_HOT", 4)
    monkeypatch.setattr(lineage, "HOT_KEYS", 10)
    draw = np.random.default_rng(2)
    rows = [(i, 1 if i % 2 else i % 7, draw.normal(0, 1, 5).tolist(), float(draw.integers(1, 5)), 0.5) for i in range(120)]
    return rows, spark.createDataFrame(rows, "face_id long, person_id long, vector array<double>, min_side double, score double").repartition(3)


def test_medoids_and_covers(spark, hot):
    rows, faces = hot
    people_of = {p: [r for r in rows if r[1] == p] for p in {r[1] for r in rows}}
    want = {p: max(m, key=lambda r: (round(float(np.dot(r[2], np.sum([x[2] for x in m], 0)) - np.dot(r[2], r[2])), 9), -r[0]))[0] for p, m in people_of.items()}
    assert {r.person_id: r.medoid for r in vectors.medoid(faces, "person_id").collect()} == want
    centroids = vectors.unit_mean(faces, "person_id")
    mean = {p: np.sum([r[2] for r in m], 0) / np.linalg.norm(np.sum([r[2] for r in m], 0)) for p, m in people_of.items()}
    near = {p: max(m, key=lambda r: (round(float(np.dot(r[2], mean[p])), 9), -r[0]))[0] for p, m in people_of.items()}
    assert {r.person_id: r.cover_face_id for r in people.covers(faces, centroids).collect()} == near
    now = spark.createDataFrame([(1, 3), (2, 3)], "person_id long, cover_face_id long")
    assert {r.person_id: r.cover_face_id for r in people.covers(faces, centroids, now).collect()} == near | {1: 3}


def test_sets(spark, hot):
    _, faces = hot
    members = faces.select(F.col("person_id").alias("set_id"), "face_id", "min_side")
    window, dealt = (sorted(map(tuple, duplicates.rank_members(members, F.desc("min_side"), "face_id", at_once=n).select("set_id", "face_id", "rank", "size").collect())) for n in (1000, 10))
    assert window == dealt and max(r[3] for r in window) > 60
    moved = members.filter("face_id > 20").select("face_id")
    left = duplicates.without_moved(members, moved, "face_id")
    sizes = {}
    for r in members.filter("face_id <= 20").collect():
        sizes[r.set_id] = sizes.get(r.set_id, 0) + 1
    assert left.columns == members.columns and left.count() == sum(n for n in sizes.values() if n > 1)
    copies = duplicates.exact_copies(members.withColumn("text", F.col("set_id").cast("string")), "face_id", "text").collect()
    of = {}
    for r in members.collect():
        of.setdefault(r.set_id, []).append(r.face_id)
    assert sorted(map(tuple, copies)) == sorted((i, min(m), len(m)) for m in of.values() for i in m)
