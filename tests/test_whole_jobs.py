"""Queries over whole tables: held against plain versions on the smallest tables."""

from collections import defaultdict

import pyarrow.parquet as pq
import pytest

import __spark_entry__ as registered

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def read():
    return lambda table, *columns: pq.read_table(f"{DATA}/{table}.parquet", columns=list(columns)).to_pylist()


def test_iou_of_the_boxes_of_all_orders(spark, read):
    orders = defaultdict(list)
    for r in read("lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"):
        q = float(r["l_quantity"])
        orders[r["l_orderkey"]].append((float(r["l_extendedprice"]), r["l_linenumber"], q, q / 2, q + 10, 20.0))
    want = {}
    for k, boxes in orders.items():
        for p1, n1, x1, y1, w1, h1 in boxes:
            for p2, n2, x2, y2, w2, h2 in boxes:
                shared = max(0, min(x1 + w1, x2 + w2) - max(x1, x2)) * max(0, min(y1 + h1, y2 + h2) - max(y1, y2))
                if p1 < p2 and shared > 0:
                    want[k, n1, n2, p1, p2] = shared / (w1 * h1 + w2 * h2 - shared)
    rows = registered.queries()["box_iou_pairs"](spark, DATA).collect()
    assert len(rows) == len(want) and {r.k % 10 for r in rows} == set(range(10))
    assert all(abs(want[r.k, r.n1, r.n2, float(r.p1), float(r.p2)] - r.iou) < 1e-6 for r in rows)


def test_links_of_all_orders(spark, read):
    newest = {}
    for r in read("lineitem", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"):
        a, b = sorted((r["l_partkey"], r["l_suppkey"]))
        if a != b:
            newest[a, b] = max(newest.get((a, b), (r["l_shipdate"], 0)), (r["l_shipdate"], r["l_linenumber"] % 2))
    rows = registered.queries()["link_faces"](spark, DATA).collect()
    assert sorted((r.face_a, r.face_b, r.kind) for r in rows) == sorted((*pair, kind) for pair, (_, kind) in newest.items())


def test_destinations_of_all_photos(spark, read):
    want, seen = {}, defaultdict(int)
    for i in sorted(r["o_orderkey"] for r in read("orders", "o_orderkey")):
        seen[i % 50] += 1
        want[i] = f"/out/{i % 50}.jpg" if seen[i % 50] == 1 else f"/out/{i % 50} ({seen[i % 50]}).jpg"
    rows = registered.queries()["unique_destinations"](spark, DATA).collect()
    assert len(rows) == len(want) > 400 and {r.photo_id: r.dst_path for r in rows} == want


def test_quarantine_of_all_photos(spark, read):
    sets = defaultdict(list)
    for i in sorted(r["o_orderkey"] for r in read("orders", "o_orderkey")):
        sets[i // 3].append(i)
    want = {i: f"/quarantine/IMG_{i}.jpg" for members in sets.values() for i in members[1:]}
    rows = registered.queries()["quarantine_plan"](spark, DATA).collect()
    assert len(rows) == len(want) and max(want) > 900 and {r.photo_id: r.dst_path for r in rows} == want


def test_clusters_of_all_sizes(spark, read):
    size = defaultdict(int)
    for r in read("lineitem", "l_partkey", "l_returnflag"):
        size[r["l_partkey"]] += r["l_returnflag"] != "R"
    want = sorted(((c, n) for c, n in size.items() if n), key=lambda x: (-x[1], x[0]))
    rows = registered.queries()["clusters_by_size"](spark, DATA).collect()
    assert len(want) > 60 and [(r.cluster_id, r.size) for r in rows] == want


def test_second_import_beyond_its_first_number(spark, tmp_path):
    spark.createDataFrame([(i, [1.0], i % 7) for i in (0, 3, 4, 100_000, 100_002, 100_003)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = registered.queries()["upsert_embeddings"](spark, str(tmp_path)).collect()
    want = [(i, i % 7 + (i % 3 == 0)) for i in (0, 3, 4, 100_000, 100_002, 100_003)] + [(i + 100_000, i % 7 + 1) for i in (0, 3, 100_002)]
    assert sorted((r.face_id, r.label) for r in rows) == sorted(want)
