"""Actions end to end, numbering without limits, joins on hot keys."""

import math

import pytest
from pyspark.sql import functions as F

from kinlight.functions import text as T
from kinlight.operators import exports, graph, people, workflows
from kinlight.plans import lineage, numbering
from kinlight.sources import sinks


def at(degrees):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))]


@pytest.fixture
def library(spark):
    persons = spark.createDataFrame([(1, "Alice", 1, None), (2, "Bob", None, None)], "person_id long, display_name string, cover_face_id long, centroid array<double>")
    rows = [(1, 1, 10, 1, at(0)), (2, 2, 20, 0, at(90)), (3, None, 30, 0, at(5)), (4, None, 30, 0, at(9)), (5, None, 40, 0, at(12)), (6, None, 40, 2, at(14)), (7, None, 50, 0, at(95)), (8, None, 60, 1, at(6)), (9, None, 70, 0, None)]
    faces = spark.createDataFrame([(*r, 50.0, 0.9) for r in rows], "face_id long, person_id long, cluster_id long, assignment int, vector array<double>, min_side double, score double")
    clusters = spark.createDataFrame([(10, 1, 1, 1), (20, 2, 1, 2), (30, None, 2, 3), (40, None, 2, 5), (50, None, 1, 7), (60, None, 1, 8), (70, None, 5, 9), (80, None, 3, 1)], "cluster_id long, person_id long, size long, medoid_face_id long")
    return workflows.Library(persons, faces, clusters)


def named(lib):
    return {r.face_id: r.person_id for r in lib.faces.collect()}, {r.cluster_id: r.person_id for r in lib.clusters.collect()}


def test_naming_a_group_absorbs_those_alike(library):
    now, outcome = workflows.name_group(library, 30, " Carol ", 7, least=0.9)
    assert outcome == {"status": "named", "person_id": 7, "faces": 3, "groups": 1}
    faces, groups = named(now)
    assert {f for f, p in faces.items() if p == 7} == {3, 4, 5} and faces[6] is None and faces[8] is None
    assert groups[30] == groups[40] == 7 and groups[50] is None and groups[60] is None
    carol = now.persons.filter("person_id = 7").first()
    assert carol.display_name == "Carol" and carol.cover_face_id == 3
    mean = [sum(x) for x in zip(at(5), at(9), at(12))]
    assert carol.centroid == pytest.approx([x / math.hypot(*mean) for x in mean])


def test_naming_like_somebody_merges(library):
    now, outcome = workflows.name_group(library, 50, "BOB", 7, least=0.99)
    assert outcome["status"] == "merged" and outcome["person_id"] == 2 and named(now)[0][7] == 2
    assert now.persons.count() == 2


@pytest.mark.parametrize(("group", "name", "status"), [(999, "X", "no such group"), (30, " ", "invalid"), (60, "X", "nothing to assign"), (10, "X", "owned by 1")])
def test_naming_refused(library, group, name, status):
    now, outcome = workflows.name_group(library, group, name, 7)
    assert outcome["status"] == status and now is library


def test_moving_removing_and_merging_calibrate(library):
    lib = workflows.recalibrate(library, [1, 2])
    now, outcome = workflows.move_faces(lib, [1], 1, 2)
    people_now = {r.person_id: r for r in now.persons.collect()}
    assert outcome == {"status": "moved", "faces": 1} and people_now[1].centroid is None
    assert people_now[2].centroid == pytest.approx([math.sqrt(0.5)] * 2)
    now, _ = workflows.remove_faces(lib, [2], 2)
    assert named(now)[0][2] is None and {r.person_id: r.centroid for r in now.persons.collect()}[2] is None
    now, outcome = workflows.merge_people(lib, 2, [1, 2])
    assert outcome == {"status": "merged", "people": 1} and [r.person_id for r in now.persons.collect()] == [2]
    assert now.persons.first().centroid == pytest.approx([math.sqrt(0.5)] * 2)
    for action, want in [(workflows.move_faces(lib, [], 1, 2), "nothing selected"), (workflows.move_faces(lib, [1], 1, 1), "same person"), (workflows.move_faces(lib, [1], 1, 5), "no such person"), (workflows.remove_faces(lib, [], 1), "nothing selected"), (workflows.remove_faces(lib, [1], 5), "no such person"), (workflows.merge_people(lib, 1, [1]), "nothing to merge"), (workflows.merge_people(lib, 1, [5]), "no such person")]:
        assert action == (lib, {"status": want})


def test_repair_twice(library):
    once, outcome = workflows.repair(library)
    assert outcome == {"people": 2, "averages_lost": 0, "covers": 1, "resized": 1, "removed": 1}
    sizes = {r.cluster_id: (r.size, r.medoid_face_id) for r in once.clusters.collect()}
    assert sizes[70][0] == 1 and 80 not in sizes and named(once)[1][10] == 1
    again, outcome = workflows.repair(once)
    assert (outcome["covers"], outcome["removed"]) == (0, 0)


def test_plans_are_checked(spark):
    roots = spark.createDataFrame([("/photos",)], "path string")
    plan = spark.createDataFrame([(1, 50), (2, 70)], "id long, bytes long")
    assert exports.checked(plan, roots, "/PHOTOS/out") == (None, "inside_root")
    assert exports.checked(plan, roots, "/photos2", 100) == (None, "no_space")
    assert exports.checked(plan.limit(0), roots, "/q") == (None, "nothing")
    assert exports.checked(plan, roots, "/q")[1] == exports.checked(plan, roots, "/q", 120)[1] == "ok"


def test_destinations_count_on_without_limit(spark):
    plan = spark.createDataFrame([(i, "/o", "a.jpg") for i in range(5)] + [(9, "/o", "A (3).jpg")], "id long, folder string, name string")
    there = spark.createDataFrame([("/o/a.jpg",), ("/o/A.JPG",)] + [(f"/o/a ({i}).jpg",) for i in range(4, 40)], "path string")
    got = {r.id: r.dst_path for r in exports.unique_destinations(plan, ["id"], there).collect()}
    assert got == {0: "/o/a (2).jpg", 1: "/o/a (40).jpg", 2: "/o/a (41).jpg", 3: "/o/a (42).jpg", 4: "/o/a (43).jpg", 9: "/o/A (3).jpg"}
    assert exports.unique_destinations(plan.limit(0), ["id"], there).count() == 0


def test_free_numbers_match_counting(spark):
    taken = [("a", t) for t in (1, 2, 5, 9, 10, 30)] + [("b", 3), ("b", 3), ("a", -1)]
    wanted = [(g, i) for g in "abc" for i in range(1, 13)]
    got = numbering.free_numbers(spark.createDataFrame(wanted, "g string, nth long"), spark.createDataFrame(taken, "g string, number long"), "g")
    want = {(g, i): [n for n in range(1, 60) if (g, n) not in taken][i - 1] for g, i in wanted}
    assert {(r.g, r.nth): r.number for r in got.collect()} == want


def test_repeated_keys_in_one_change(spark):
    base = spark.createDataFrame([(1, "/A", 5), (2, "/b", 2)], "id long, path string, size long")
    change = spark.createDataFrame([(7, "/a", 6), (8, "/A", 9), (9, "/n", 1), (10, "/N", 1), (11, None, 1)], "id long, path string, size long")
    got = sorted((r.id, r.size) for r in sinks.upsert_by_path(base, change, ["size"]).filter("path is not null").collect())
    assert got == [(1, 9), (2, 2), (10, 1)]
    keyed = sinks.upsert(base, change.union(change.withColumn("size", F.lit(3).cast("long"))), ["id"], ["size"])
    assert keyed.count() == 7 and {r.id: r.size for r in keyed.collect()}[7] == 6
    person = spark.createDataFrame([(1, "New")], "person_id long, display_name string")
    saved = people.save_person(spark.createDataFrame([(1, "Old", 4), (2, "B", None)], "person_id long, display_name string, cover_face_id long"), person)
    assert sorted(map(tuple, saved.collect()), key=str) == [(1, "New", None), (2, "B", None)]


def test_published_table_is_recovered(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    assert not sinks.recover(spark, path)
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert sinks.recover(spark, path) and spark.read.parquet(path).count() == 3


def test_new_ids_are_of_version_7(spark):
    ids = [r.u for r in spark.range(50).select(T.uuid7(F.lit("2024-01-01").cast("timestamp")).alias("u")).collect()]
    assert len(set(ids)) == 50 and all(u[14] == "7" and u[19] in "89ab" and len(u) == 36 for u in ids)
    assert {int(u[:8] + u[9:13], 16) for u in ids} == {1704067200000}


def test_a_hub_stays_where_its_edges_are(spark):
    n = 100_000
    star = spark.range(1, n + 1, numPartitions=8).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    parts = graph.connected_components(star)
    assert parts.count() == n + 1 and parts.filter("component <> 0").isEmpty()
    pairs = star.select(F.lit(0).cast("long").alias("u"), F.col("a").alias("v"))
    held = graph._toward_minimum(pairs, n).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in held) == n and max(r["count"] for r in held) < n / 4


def test_a_hot_key_is_dealt_out(spark):
    left = spark.range(0, 60_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    table = left.groupBy("k").agg(F.count("*").alias("n"))
    joined = lineage.join_spread(left, table, ["k"], "v")
    assert joined.agg(F.sum("n")).first()[0] == 20_000**2 + 40_000 and joined.count() == 60_000
    assert lineage.broadcast_if_small(spark.range(10).withColumn("t", F.lit("x" * 100)), max_bytes=50)._jdf.queryExecution().toString().count("broadcast") == 0


def test_actions_by_sums_end_as_those_by_all_vectors(library):
    from kinlight.operators import sums

    plain = workflows.recalibrate(library, [1, 2])
    kept = workflows.replace(plain, sums=sums.sums_of(plain.faces))
    for act in (lambda lib: workflows.name_group(lib, 30, "Carol", 7, least=0.9)[0], lambda lib: workflows.move_faces(lib, [1, 3], 7, 2)[0], lambda lib: workflows.remove_faces(lib, [4], 7)[0], lambda lib: workflows.merge_people(lib, 2, [7])[0]):
        plain, kept = act(plain), act(kept)
        rows = [{r.person_id: r for r in lib.persons.collect()} for lib in (plain, kept)]
        assert rows[0].keys() == rows[1].keys()
        for p, r in rows[0].items():
            assert (r.cover_face_id, r.display_name) == (rows[1][p].cover_face_id, rows[1][p].display_name)
            assert r.centroid == (rows[1][p].centroid if rows[1][p].centroid is None else pytest.approx(rows[1][p].centroid, abs=1e-9))
    assert sums.repaired(kept.sums, kept.faces)[1].count() == 0
