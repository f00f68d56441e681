"""Search by trigrams: the rows of a scan, from few files."""

import random

import pytest
from pyspark.sql import functions as F

from kinlight.functions.text import contains_text
from kinlight.operators import lookups, search, text_index
from kinlight.operators.text_index import TextIndex


def paths(spark, first, n):
    rng = random.Random(first)
    words = ["Ferien", "strand", "ÄRGER", "日本語", "a_b%c", "back\\slash", "IMG"]
    rows = [(i, f"/lib/{rng.choice(words)}/{rng.choice(words)}_{rng.randrange(10_000)}.JPG") for i in range(first, first + n)]
    return spark.createDataFrame([*rows, (first + n, ""), (first + n + 1, None), (first + n + 2, "ab")], "photo_id long, path string")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i")
    assert index.batches() == 0 and index.candidates("abc") is None
    one, two = paths(spark, 0, 400), paths(spark, 1000, 300)
    index.add(one, "photo_id", "path")
    index.add(two.unionByName(two.limit(1)), "photo_id", "path")
    return index, one.unionByName(two).cache()


@pytest.mark.parametrize("fragment", ["rand/IMG", "日本語_1", "ärger", "ÄRGER/a_", "_b%C", "k\\s", "12", "ab", ".jpg", "/lib/", "nowhere", "   ", "", "_123", " x"])
def test_rows_of_a_scan(indexed, fragment):
    index, table = indexed
    want = sorted(r.photo_id for r in table.filter(contains_text("path", fragment)).collect())
    assert sorted(r.photo_id for r in index.search(table, "photo_id", "path", fragment).collect()) == want
    assert sorted(r.photo_id for r in lookups.search_path(table, fragment, index=index).collect()) == want


def test_file_names(indexed):
    index, table = indexed
    plain, by_index = ([tuple(r) for r in lookups.search_path(table, " iMg_1 ", scope="name", index=i).collect()] for i in (None, index))
    assert sorted(plain) == sorted(by_index) and plain


def test_when_a_scan_is_due(indexed):
    index, _ = indexed
    assert index.candidates("ab") is None and index.candidates(".jpg") is None
    assert index.candidates("nowhere").count() == 0


def test_files_read(indexed, spark):
    index, _ = indexed
    gram = "日本語"
    read = index.postings([gram])
    plan = read._jdf.queryExecution()
    assert read.count() > 0 and "PartitionFilters: [" in plan.toString() and "PushedFilters: [" in plan.toString()
    part = spark.range(1).select(F.pmod(F.xxhash64(F.lit(gram)), F.lit(text_index.PARTS))).first()[0]
    scan = plan.executedPlan().collectLeaves().apply(0)
    read._jdf.queryExecution().executedPlan().executeCollect()
    everything = spark.read.option("basePath", f"{index.folder}/postings").parquet(f"{index.folder}/postings/batch=1", f"{index.folder}/postings/batch=2").inputFiles()
    mine = [f for f in everything if f"part={part}/" in f]
    assert scan.metrics().apply("numFiles").value() == len(mine) < len(everything) / 10


def test_a_batch_that_was_stopped(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i")
    spark.range(1).write.parquet(f"file://{tmp_path}/i/postings/batch=1")
    assert index.batches() == 0
    table = paths(spark, 0, 20)
    index.add(table, "photo_id", "path")
    assert index.batches() == 1 and index.postings(["lib"]).count() == 20
    empty = TextIndex(spark, f"file://{tmp_path}/e")
    empty.add(table.limit(0), "photo_id", "path")
    assert empty.batches() == 1 and empty.search(table.limit(0), "photo_id", "path", "ferien").count() == 0


def test_search_with_people(spark, tmp_path):
    photos = spark.createDataFrame([(i, f"/x/Trip_{i}.jpg") for i in range(40)], "photo_id long, path string").withColumn("taken_utc", F.timestamp_seconds("photo_id"))
    faces = spark.createDataFrame([(i, i % 3, "d", True) for i in range(40)], "photo_id long, person_id long, detector_id string, active boolean")
    persons = spark.createDataFrame([(i, f"p{i}") for i in range(3)], "person_id long, display_name string")
    index = TextIndex(spark, f"file://{tmp_path}/i")
    index.add(photos, "photo_id", "path")
    for asked in ({"text": "trip_3"}, {"people": [1], "text": "p_1"}):
        plain, by_index = (search.search(photos, faces, persons, **asked, index=i).collect() for i in (None, index))
        assert sorted(plain) == sorted(by_index) and plain
