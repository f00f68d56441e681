import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinlight.operators import clustering, duplicates, exports, graph, lookups, maintenance, people, search, vectors
from kinlight.sources import schema, sinks


def at(degrees, dims=4):
    return [math.cos(math.radians(degrees)), math.sin(math.radians(degrees))] + [0.0] * (dims - 2)


def edges(spark, rows):
    return spark.createDataFrame(rows, "a long, b long")


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in rows:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in graph.connected_components(edges(spark, rows + [(None, 3), (4, None)])).collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert graph.connected_components(edges(spark, [])).count() == 0


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "face_id long, vector array<double>")
    for block in (2048, 37):
        got = {(r.src, r.rank): (r.dst, round(r.similarity, 9)) for r in vectors.knn(df, 5, 0.1, block=block).collect()}
        want = {}
        for i in range(120):
            sims = sorted(((-float(v[i] @ v[j]), j) for j in range(120) if j != i and v[i] @ v[j] >= 0.1))[:5]
            want |= {(i, n + 1): (j, round(-s, 9)) for n, (s, j) in enumerate(sims)}
        assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert got[(3, 1)][0] == 7
    pairs = {(r.a, r.b) for r in vectors.similar_pairs(df, 0.3, block=50).collect()}
    assert pairs == {(i, j) for i in range(120) for j in range(i + 1, 120) if v[i] @ v[j] >= 0.3}
    with pytest.raises(ValueError):
        vectors.knn(df, 0)
    assert vectors.knn(df.limit(0)).count() == 0


def test_knn_refuses_mixed_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "face_id long, vector array<double>")
    with pytest.raises(Exception, match="dimension|inhomogeneous"):
        vectors.knn(df).collect()


def test_nearest_centroid_both_ways(spark):
    draw = np.random.default_rng(5)

    def unit(n):
        v = draw.normal(size=(n, 6))
        return v / np.linalg.norm(v, axis=1)[:, None]

    items, people = unit(130), unit(17)
    people[9] = people[3]  # a tie: the smaller name wins
    items[0] = people[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)] + [(900, None), (901, [])], "id long, centroid array<double>")
    known = spark.createDataFrame([(i + 50, v.tolist()) for i, v in enumerate(people)] + [(40, []), (41, None)], "person_id long, centroid array<double>")
    sim = items @ people.T
    want = {i: (int(row.argmax()) + 50, round(row.max(), 9)) for i, row in enumerate(sim) if row.max() >= 0.3}
    assert want[0][0] == 53
    for rows in (1000, 1):  # sent to all tasks, or met in blocks
        found = vectors.nearest_centroid(df, known, 0.3, block=7, max_rows=rows)
        assert {r.id: (r.name, round(r.similarity, 9)) for r in found.collect()} == want
        assert vectors.nearest_centroid(df, known.limit(0), 0.3, max_rows=rows).count() == 0
        assert vectors.nearest_centroid(df.limit(0), known, 0.3, max_rows=rows).count() == 0
    plan = vectors.nearest_centroid(df, known, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_similar_pairs_inside_groups(spark):
    draw = np.random.default_rng(6)
    v = draw.normal(size=(90, 5))
    v /= np.linalg.norm(v, axis=1)[:, None]
    of = [None if i % 30 == 0 else 0 if i < 60 else i % 3 for i in range(90)]
    df = spark.createDataFrame([(i, g, x.tolist()) for i, (g, x) in enumerate(zip(of, v, strict=True))], "face_id long, label int, vector array<double>")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if of[i] is not None and of[i] == of[j] and v[i] @ v[j] >= 0.4}
    assert {(r.a, r.b) for r in vectors.similar_pairs(df, 0.4, within="label", block=16).collect()} == want


def test_unit_mean_and_medoid(spark):
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (1, 3, None), (2, 4, [1.0, 0.0]), (2, 5, [-1.0, 0.0]), (3, 6, at(0, 2)), (3, 7, at(10, 2)), (3, 8, at(40, 2))], "k long, face_id long, vector array<double>")
    c = {r.k: r.centroid for r in vectors.unit_mean(df, "k").collect()}
    assert c[1] == pytest.approx([0.7071, 0.7071], abs=1e-4) and c[2] == [0, 0]
    assert {r.k: r.centroid for r in vectors.unit_mean(df, "k", zero_as_null=True).collect()}[2] is None
    assert {r.k: r.medoid for r in vectors.medoid(df, "k").collect()} == {1: 1, 2: 4, 3: 7}


def graph_of(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, similarity double")


def groups(spark, n, rows, must=None, cannot=None):
    nodes = spark.range(n).select(F.col("id").alias("node"))
    e = clustering.build_edges(graph_of(spark, rows), edges(spark, cannot) if cannot else None)
    found = clustering.chinese_whispers(nodes, e, edges(spark, must) if must else None).collect()
    return {r.node: r.label for r in found}


def test_label_propagation(spark):
    tri = [(0, 1, 0.8), (1, 2, 0.8), (2, 0, 0.8), (3, 4, 0.8), (4, 5, 0.8), (5, 3, 0.8)]
    assert groups(spark, 7, tri) == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3, 6: 6}
    k4 = [(a + o, b + o, 0.9) for o in (0, 4) for a in range(4) for b in range(4) if a != b] + [(3, 4, 0.36)]
    assert set(groups(spark, 8, k4).values()) == {0, 4}
    assert len(set(groups(spark, 3, [(0, 1, 0.9), (1, 2, 0.2)], must=[(0, 2)]).values())) == 1
    assert len(set(groups(spark, 2, [(0, 1, 0.99), (1, 0, 0.99)], cannot=[(0, 1)]).values())) == 2
    assert groups(spark, 2, [(0, 1, 0.5)]) == {0: 0, 1: 0}
    labels = spark.createDataFrame(list(groups(spark, 7, tri).items()), "node long, label long")
    assert {r.label: r.group_no for r in clustering.compact_labels(labels).collect()} == {0: 0, 3: 1, 6: 2}


def test_planted_groups_are_pure(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 32))
    rows = []
    for i in range(240):
        v = centre[i % 12] + rng.normal(size=32) * 0.25
        rows.append((i, [float(x) for x in v / np.linalg.norm(v)]))
    df = spark.createDataFrame(rows, "face_id long, vector array<double>")
    first = {r.face_id: r.cluster_id for r in clustering.cluster_faces(df, least=0.5).collect()}
    assert {r.face_id: r.cluster_id for r in clustering.cluster_faces(df, least=0.5).collect()} == first
    for c in set(first.values()):
        assert len({f % 12 for f, x in first.items() if x == c}) == 1
    assert len(set(first.values())) == 12


def test_face_sets_are_transitive(spark):
    v = spark.createDataFrame([(1, 1, at(0)), (2, 1, at(20)), (3, 1, at(40)), (4, 1, at(85)), (5, 2, at(0))], "face_id long, person_id long, vector array<double>")
    d = spark.createDataFrame([(1, False, 90, 10.0, 0.9), (2, True, 50, None, 0.9), (3, False, 90, 20.0, 0.9)], "face_id long, confirmed boolean, face_px int, sharpness double, score double")
    got = sorted((r.face_id, r.set_id, r.rank, r.size) for r in duplicates.duplicate_faces(v, d).collect())
    assert got == [(1, 1, 3, 3), (2, 1, 1, 3), (3, 1, 2, 3)]


def test_people_sets(spark):
    c = spark.createDataFrame([(1, at(0)), (2, at(40)), (3, at(80)), (4, None)], "person_id long, centroid array<double>")
    d = spark.createDataFrame([(1, "b", 2, 9), (2, "A", 5, 9), (3, "C", 2, 9)], "person_id long, display_name string, photos long, faces long")
    got = {r.person_id: (r.set_id, r.rank) for r in duplicates.duplicate_people(c, d).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (1, 3)}


def sig(spark, rows):
    return spark.createDataFrame([(i, (1 << bits) - 1, 0, s, t, 10, None) for i, bits, s, t in rows], "photo_id long, gradient long, brightness long, sharpness double, taken string, file_size long, mtime_utc timestamp").withColumn("taken_utc", F.col("taken").cast("timestamp"))


def test_photo_sets(spark):
    got = {r.photo_id: (r.set_id, r.rank, r.distance_from_best) for r in duplicates.duplicate_photos(sig(spark, [(1, 0, 10.0, None), (2, 8, 900.0, None), (3, 16, 100.0, "2024-01-01"), (4, 40, 1.0, None)])).collect()}
    assert got == {1: (1, 3, 8), 2: (1, 1, 0), 3: (1, 2, 8)}
    apart = sig(spark, [(1, 0, 1.0, "2023-01-01"), (2, 0, 1.0, "2024-01-01")])
    assert duplicates.duplicate_photos(apart).count() == 0
    assert duplicates.duplicate_photos(apart, seconds=None).count() == 2
    assert duplicates.duplicate_photos(sig(spark, [(1, 0, 1.0, None), (2, 20, 1.0, None)])).count() == 0


@pytest.mark.parametrize("bits", [0, 5, 12, 40])
def test_hash_pairs_match_brute_force(spark, bits):
    rng = random.Random(bits)
    words = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(30)]
    for a, b in words[:20]:
        for _ in range(rng.randrange(bits + 3)):
            i = rng.randrange(128)
            a, b = (a ^ (1 << i), b) if i < 64 else (a, b ^ (1 << (i - 64)))
        words.append((a, b))
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in w) for w in words]
    df = spark.createDataFrame([(i, *w) for i, w in enumerate(signed)], "photo_id long, gradient long, brightness long")
    want = {(i, j): d for i in range(50) for j in range(i + 1, 50) if (d := (words[i][0] ^ words[j][0]).bit_count() + (words[i][1] ^ words[j][1]).bit_count()) <= bits}
    assert {(r.a, r.b): r.distance for r in duplicates.hash_pairs(df, bits).collect()} == want
    blocks = duplicates._pairs_by_blocks(df.withColumnRenamed("photo_id", "id"), bits, 20)
    assert {(r.a, r.b): r.distance for r in blocks.collect()} == want


def test_moved_and_selected(spark):
    m = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, True), (2, 4, True), (2, 5, True)], "set_id long, photo_id long, selected boolean").withColumn("file_size", F.lit(10))
    left = duplicates.without_moved(m, m.filter("photo_id in (2, 3)"), "photo_id")
    assert sorted(r.photo_id for r in left.collect()) == [4, 5]
    assert {r.set_id: (r.all_selected, r.selected, r.bytes) for r in duplicates.selection(m).collect()} == {1: (False, 1, 10), 2: (True, 3, 30)}


@pytest.fixture(scope="module")
def library(spark):
    photos = spark.createDataFrame([(i, f"/lib/IMG_{i:02}.jpg", f"2024-01-{i % 28 + 1:02}", 100) for i in range(1, 21)] + [(99, "/lib/IMGX01.jpg", None, 5)], "photo_id long, path string, taken string, file_size long").withColumn("taken_utc", F.col("taken").cast("timestamp")).withColumn("mtime_utc", F.lit("2020-01-01").cast("timestamp"))
    faces = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 1, True), (3, 2, True), (3, 1, False), (4, None, True)], "photo_id long, person_id long, active boolean").withColumns({"detector_id": F.lit("d"), "assignment": F.lit(0), "cluster_id": F.lit(7), "face_id": F.col("photo_id")})
    persons = spark.createDataFrame([(1, "Alice"), (2, "bob")], "person_id long, display_name string")
    return photos, faces, persons


def test_search(spark, library):
    def ids(**kw):
        return [r.photo_id for r in search.search(*library, **kw).orderBy("position").collect()]

    assert ids(people=[1, 2, 1]) == [1]
    assert ids(people=[1, 2], match_all=False) == [3, 2, 1]
    assert ids(people=[1, 77]) == [] and ids(people=[1, 77], match_all=False) == [2, 1]
    assert ids() == [] and ids(text="  ") == []
    assert ids(text="IMG_01") == [1]
    assert ids(text="lib", people=[1]) == [] and ids(text="lib", people=[1], scope="path") == [2, 1]
    r = search.search(*library, people=[1, 2], match_all=False, limit=2).orderBy("position").collect()
    assert [x.photo_id for x in r] == [3, 2] and r[0].total == 3 and r[0].truncated and r[0].names == "bob"


def test_people_changes(spark, library):
    photos, faces, persons = library

    def tally(f):
        return sorted((r.photo_id, r.person_id or 0, r.assignment) for r in f.collect())

    decided = faces.withColumn("assignment", F.when(F.col("photo_id") == 3, 2).otherwise(0))
    p, f, _ = people.merge_people(persons, decided, None, 1, [2, 2, 1])
    assert [r.person_id for r in p.collect()] == [1]
    assert tally(f) == [(1, 1, 0), (1, 1, 1), (2, 1, 0), (3, 1, 2), (3, 1, 2), (4, 0, 0)]
    p, f, _ = people.delete_person(persons, decided, None, 2)
    assert tally(f) == [(1, 0, 0), (1, 1, 0), (2, 1, 0), (3, 0, 2), (3, 1, 2), (4, 0, 0)]
    assert people.rename_person(persons, 1, " BOB ").filter("display_name = 'Alice'").count() == 1
    assert people.rename_person(persons, 1, "Zoe").filter("display_name = 'Zoe'").count() == 1
    assert people.rename_person(persons, 1, " ").filter("display_name = 'Alice'").count() == 1
    assert people.name_cluster(persons, faces, 7, "BOB", 50)[2] == "merged"
    p, f, how = people.name_cluster(persons, faces, 7, "Carl", 50)
    assert how == "named" and f.filter("person_id = 50").count() == 6
    assert people.name_cluster(persons, faces.withColumn("assignment", F.lit(1)), 7, "Carl", 50)[2] == "nothing to assign"
    assert people.name_cluster(persons, faces.filter("person_id = 1").withColumn("assignment", F.lit(1)), 7, "Carl", 50)[2] == "owned by 1"
    assert people.name_cluster(persons, faces, 7, "", 50)[2] == "invalid"
    o = {r.person_id: (r.faces, r.photos) for r in people.overview(persons, faces).collect()}
    assert o == {1: (2, 2), 2: (2, 2)}


def test_covers(spark):
    f = spark.createDataFrame([(1, 1, at(0), 60.0, 0.9), (2, 1, at(5), 60.0, 0.9), (3, 1, at(80), 400.0, 0.9), (4, 2, None, 50.0, 0.8), (5, 2, None, 90.0, 0.7)], "face_id long, person_id long, vector array<double>, min_side double, score double")
    c = vectors.unit_mean(f, "person_id")
    assert {r.person_id: r.cover_face_id for r in people.covers(f, c).collect()} == {1: 2, 2: 5}
    now = spark.createDataFrame([(1, 3), (2, 77)], "person_id long, cover_face_id long")
    assert {r.person_id: r.cover_face_id for r in people.covers(f, c, now).collect()} == {1: 3, 2: 5}


def test_auto_names_skip_taken(spark):
    c = spark.createDataFrame([(1, 5), (2, 9), (3, 1)], "cluster_id long, size long")
    t = spark.createDataFrame([("person 2",), ("Person 1",), ("Person x",)], "display_name string")
    assert {r.cluster_id: r.display_name for r in people.auto_names(c, t).collect()} == {2: "Person 3", 1: "Person 4", 3: "Person 5"}
    assert {r.display_name for r in people.auto_names(c, t.limit(0)).collect()} == {"Person 1", "Person 2", "Person 3"}


def test_repair_is_idempotent(spark):
    clusters = spark.createDataFrame([(1, 9, 1), (2, 2, 5), (3, 1, 7)], "cluster_id long, size long, medoid_face_id long")
    members = spark.createDataFrame([(1,), (1,), (2,), (2,)], "cluster_id long")
    medoids = spark.createDataFrame([(1, 1), (2, 5)], "cluster_id long, medoid long")
    once = people.repair_clusters(clusters, members, medoids)
    assert {r.cluster_id: r.action for r in once.collect()} == {1: "fixed", 2: "kept", 3: "removed"}
    again = people.repair_clusters(once.filter("action <> 'removed'").drop("action"), members, medoids)
    assert {r.action for r in again.collect()} == {"kept"}


def test_destinations_dodge_made_up_names(spark):
    rows = [(1, "a.jpg"), (2, "A.JPG"), (3, "a (2).jpg"), (4, "b"), (5, "b")]
    plan = spark.createDataFrame(rows, "id long, name string").withColumn("folder", F.lit("/o"))
    taken = spark.createDataFrame([("/o/B",)], "path string")
    got = {r.id: r.dst_path for r in exports.unique_destinations(plan, ["id"], taken).collect()}
    assert len({p.lower() for p in got.values()}) == 5 and "/o/b" not in {p.lower() for p in got.values()}
    assert got[1] == "/o/a.jpg" and got[3] == "/o/a (2).jpg"


def test_export_copy_and_move(spark, library):
    photos, faces, persons = library
    appear = search.appearances(faces)
    copy = exports.plan_export(appear, photos, persons, "/out/", move=False)
    assert sorted(r.dst_path for r in copy.collect()) == ["/out/Alice/IMG_01.jpg", "/out/Alice/IMG_02.jpg", "/out/bob/IMG_01.jpg", "/out/bob/IMG_03.jpg"]
    move = exports.plan_export(appear, photos, persons, "/out", move=True)
    assert sorted(r.dst_path for r in move.collect()) == ["/out/Alice/IMG_01.jpg", "/out/Alice/IMG_02.jpg", "/out/bob/IMG_03.jpg"]
    assert exports.plan_bytes(move, 250).first().fits is False and exports.plan_bytes(move).first().fits
    roots = spark.createDataFrame([("/lib",)], "path string")
    assert exports.inside_any(roots, "/LIB") and not exports.inside_any(roots, "/library")


def test_scan_roots(spark):
    roots = spark.createDataFrame([("/a/b",), ("/c",)], "path string")
    assert exports.add_scan_root(roots, "/x", exists=False)[1] == "not_found"
    assert exports.add_scan_root(roots, "/C/")[1] == "already_present"
    assert exports.add_scan_root(roots, "/c/d")[1] == "already_covered"
    new, how = exports.add_scan_root(roots, "/a")
    assert how == "added" and sorted(r.path for r in new.collect()) == ["/a", "/c"]


def test_undo(spark):
    ops = spark.createDataFrame([(1, "/s/1", "/d/1", 1), (2, "/s/2", "/d/2", 1), (3, "/s/3", "/d/3", 1), (4, "/s/4", "/d/4", 3)], "id long, src_path string, dst_path string, status int")
    files = spark.createDataFrame([("/d/1",), ("/D/2",), ("/S/2",)], "path string")
    plan = exports.plan_undo(ops, files)
    assert {r.id: r.outcome for r in plan.collect()} == {1: "undone", 2: "blocked", 3: "blocked"}
    assert tuple(exports.undo_status(plan).first()) == (1, 2, False)


def test_execute_reports_outcomes(spark, tmp_path):
    plan = spark.createDataFrame([(1, "a", "ok"), (2, "a", "there"), (3, "a", "bad")], "id long, src_path string, dst_path string")

    def act(src, dst):
        if dst == "there":
            raise FileExistsError(dst)
        if dst == "bad":
            raise OSError("no")
        return 7

    assert sorted((r.id, r.status, r.bytes) for r in exports.execute(plan, act).collect()) == [(1, 1, 7), (2, 3, 0), (3, 2, 0)]


def test_sinks(spark, tmp_path):
    base = spark.createDataFrame([(1, "/A", 1), (2, "/b", 2)], "id long, path string, size long")
    change = spark.createDataFrame([(8, "/a", 5), (9, "/n", 6)], "id long, path string, size long")
    assert sorted(map(tuple, sinks.upsert_by_path(base, change).collect())) == [(1, "/a", 5), (2, "/b", 2), (9, "/n", 6)]
    assert sorted(r.path for r in sinks.insert_absent(base, change, ["path"], ["path"]).collect()) == ["/A", "/b", "/n"]
    target = str(tmp_path / "t")
    sinks.publish(base, target)
    sinks.publish(spark.read.parquet(target).filter("id = 1"), target)
    assert [r.id for r in spark.read.parquet(target).collect()] == [1]
    sinks.write_partitions(base.select("id", "size"), str(tmp_path / "p"), ["size"])
    sinks.write_partitions(spark.createDataFrame([(7, 2)], "id long, size long"), str(tmp_path / "p"), ["size"])
    assert sorted((r.id, r.size) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [(1, 1), (7, 2)]
    ops = spark.createDataFrame([(1, 0, 0, None), (2, 0, 0, None)], "id long, status int, bytes long, error string")
    done = spark.createDataFrame([(2, 1, 9, None)], "id long, status int, bytes long, error string")
    assert sorted((r.id, r.status) for r in sinks.journal_update(ops, done).collect()) == [(1, 0), (2, 1)]


def test_store(spark):
    store, applied = maintenance.migrate({}, spark.createDataFrame([], schema.SCHEMA_VERSION))
    assert applied == [1, 2, 3, 4] and set(store) == set(schema.TABLES) and maintenance.is_empty(store)
    assert maintenance.migrate(store, spark.createDataFrame([(4,)], "version int"))[1] == []
    tables = {
        "photos": spark.createDataFrame([(1,), (2,)], "id long"),
        "faces": spark.createDataFrame([(10, 1, 5, 3), (11, 2, 5, 4)], "id long, photo_id long, person_id long, cluster_id long"),
        "face_embeddings": spark.createDataFrame([(10,), (11,)], "face_id long"),
        "face_links": spark.createDataFrame([(10, 11)], "face_a long, face_b long"),
        "persons": spark.createDataFrame([(6,)], "id long"),
        "clusters": spark.createDataFrame([(4, 6)], "id long, person_id long"),
    }
    left = maintenance.delete_photos(tables, spark.createDataFrame([(1,)], "id long"))
    assert [tuple(r) for r in left["faces"].collect()] == [(11, 2, None, 4)]
    assert left["face_embeddings"].count() == 1 and left["face_links"].count() == 0
    assert all(t.isEmpty() for t in maintenance.reset(tables).values())


def test_queues(spark):
    photos = spark.createDataFrame([(1, 0), (2, 2), (3, 99), (4, 2)], "photo_id long, state int")
    done = spark.createDataFrame([(1, "d"), (2, "d"), (4, "other")], "photo_id long, detector_id string")
    assert sorted(r.photo_id for r in lookups.needing_detection(photos, done, "d").collect()) == [1, 4]
