"""Cascades over many rows: dealt by the number of rows, with the rows of the plain delete."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from kinlight import catalog
from kinlight.operators import maintenance
from kinlight.plans import lineage

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def shuffled(spark, monkeypatch):
    """As on large tables: nothing is broadcast, and a task takes 50 rows."""
    monkeypatch.setattr(lineage, "TASK_ROWS", 50, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _store(spark, photos):
    faces = [(10 * p + k, p, k) for p in range(photos) for k in range(3)] + [(10 * photos, None, 0)]
    return {
        "photos": spark.range(photos),
        "faces": spark.createDataFrame(faces, "id long, photo_id long, person_id long"),
        "face_embeddings": spark.createDataFrame([(f[0],) for f in faces], "face_id long"),
        "face_links": spark.createDataFrame([(f[0], f[0] + 10) for f in faces if f[0] < 10 * photos - 10], "face_a long, face_b long"),
        "photo_signatures": spark.createDataFrame([(p,) for p in range(0, photos, 2)], "photo_id long"),
    }


@pytest.mark.parametrize("photos", [200, 800])
def test_tasks_take_no_more_rows_of_larger_tables(spark, shuffled, photos):
    left = maintenance.delete_photos(_store(spark, photos), spark.range(0, photos, 9))
    kept = {p for p in range(photos) if p % 9}
    grouped = left["faces"].groupBy("photo_id", "person_id").agg(F.count("*").alias("n"))
    for table in (left["photos"], left["faces"], grouped, left["face_embeddings"]):
        assert 0 < max(len(rows) for rows in table.rdd.glom().collect()) <= 100
    assert sorted(map(tuple, grouped.collect())) == [(p, k, 1) for p in sorted(kept) for k in range(3)]
    faces = {10 * p + k for p in kept for k in range(3)}
    assert sorted(r.face_id for r in left["face_embeddings"].collect()) == sorted(faces)
    assert sorted(map(tuple, left["face_links"].collect())) == sorted((f, f + 10) for f in faces if f + 10 in faces)
    assert {r.photo_id for r in left["photo_signatures"].collect()} == {p for p in kept if p % 2 == 0}


def test_query_matches_sql(spark, shuffled):
    connection = duckdb.connect()
    for name in ("orders", "lineitem"):
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    rows = registered.queries()["cascade_photos"](spark, DATA)
    want = connection.sql(f"SELECT photo_id, person_id, n FROM ({catalog.ORACLE_SQL['cascade_photos']})").fetchall()
    assert rows.rdd.getNumPartitions() >= 100 and sorted(map(tuple, rows.select("photo_id", "person_id", "n").collect())) == sorted(want)
