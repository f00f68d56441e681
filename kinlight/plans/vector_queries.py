"""Registered queries: neighbours, centroids, duplicates, clustering, boxes and picture hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlight.functions import geometry as G
from kinlight.functions import imaging
from kinlight.operators import clustering, duplicates, people, vectors
from kinlight.plans.registry import query, with_views
from kinlight.sources import tables
from kinlight.streaming import picture_bursts

#: The vectors at hand have little structure, so queries use lower thresholds than the library's own.
NEAR, SAME = 0.35, 0.40

_DOT = "list_sum(list_transform(list_zip(a.vector, b.vector), lambda z: z[1] * z[2]))"


@query(f"""{with_views("vectors")}, near AS (SELECT a.face_id AS src, b.face_id AS dst, {_DOT} AS similarity FROM vectors a JOIN vectors b ON a.face_id <> b.face_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) AS rank FROM near WHERE similarity >= {NEAR})
    SELECT src, dst, round(similarity, 6) AS similarity, rank FROM ranked WHERE rank <= 20""")
def knn_edges(spark, d):
    n = vectors.knn(tables.vectors(spark, d), 20, NEAR)
    return n.select("src", "dst", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(f"""{with_views("vectors")}, near AS (SELECT a.face_id AS src, b.face_id AS dst, {_DOT} AS weight FROM vectors a JOIN vectors b ON a.face_id <> b.face_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM near WHERE weight >= {NEAR}),
    kept AS (SELECT src, dst, weight FROM ranked WHERE rank <= 20), both_ways AS (SELECT * FROM kept UNION ALL SELECT dst, src, weight FROM kept)
    SELECT src, dst, count(*) AS entries, round(sum(weight), 6) AS weight FROM both_ways
    WHERE NOT (least(src, dst) % 10 = 0 AND greatest(src, dst) % 2 = 1) GROUP BY src, dst""")
def neighbour_graph(spark, d):
    n = vectors.knn(tables.vectors(spark, d), 20, NEAR)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    cannot = n.select(low.alias("a"), high.alias("b")).filter("a % 10 = 0 and b % 2 = 1").distinct()
    e = clustering.build_edges(n, cannot)
    return e.groupBy("src", "dst").agg(F.count("*").alias("entries"), F.round(F.sum("weight"), 6).alias("weight"))


@query(f"""{with_views("vectors", "centroids")} SELECT person_id, unnest(range(64)) AS pos, round(unnest(centroid), 6) AS value FROM centroids""")
def person_centroid(spark, d):
    c = vectors.unit_mean(tables.vectors(spark, d), "person_id")
    return c.select("person_id", F.posexplode("centroid").alias("pos", "value")).select("person_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"""{with_views("vectors")}, near AS (SELECT a.person_id, a.face_id, coalesce(sum(CASE WHEN a.face_id <> b.face_id THEN {_DOT} END), 0.0) AS score
        FROM vectors a JOIN vectors b ON a.person_id = b.person_id GROUP BY a.person_id, a.face_id)
    SELECT person_id, face_id AS medoid FROM near QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY round(score, 9) DESC, face_id) = 1""")
def cluster_medoid(spark, d):
    return vectors.medoid(tables.vectors(spark, d), "person_id")


@query(f"""{with_views("vectors", "centroids")}, near AS (SELECT a.person_id, face_id, list_sum(list_transform(list_zip(vector, centroid), lambda z: z[1] * z[2])) AS s
        FROM vectors a JOIN centroids c ON a.person_id = c.person_id)
    SELECT person_id, face_id AS cover_face_id FROM near QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY round(s, 9) DESC, face_id) = 1""")
def person_cover(spark, d):
    v = tables.vectors(spark, d).withColumns({"min_side": F.lit(1.0), "score": F.lit(1.0)})
    return people.covers(v, vectors.unit_mean(v, "person_id"))


@query(f"""{with_views("vectors", "centroids")}, near AS (SELECT face_id, c.person_id, list_sum(list_transform(list_zip(vector, centroid), lambda z: z[1] * z[2])) AS s
        FROM vectors, centroids c)
    SELECT face_id AS id, person_id AS name, round(s, 6) AS similarity FROM near WHERE s >= 0.3
    QUALIFY row_number() OVER (PARTITION BY face_id ORDER BY s DESC, person_id) = 1""")
def nearest_centroid(spark, d):
    n = _nearest(tables.vectors(spark, d))
    return n.select("id", F.col("name").cast("long").alias("name"), F.round("similarity", 6).alias("similarity"))


def _nearest(v):
    people_at = vectors.unit_mean(v, "person_id").select("person_id", "centroid")
    items = v.select("face_id", F.col("vector").alias("centroid"))
    return vectors.nearest_centroid(items, people_at, 0.3, id_col="face_id")


@query(f"""{with_views("vectors", "centroids")}, one AS (SELECT centroid AS c FROM centroids WHERE person_id = 11)
    SELECT person_id AS cluster_id, round(list_sum(list_transform(list_zip(centroid, c), lambda z: z[1] * z[2])), 6) AS similarity FROM centroids, one
    WHERE person_id % 2 = 0 AND list_sum(list_transform(list_zip(centroid, c), lambda z: z[1] * z[2])) >= 0.1""")
def absorb_groups(spark, d):
    c = vectors.unit_mean(tables.vectors(spark, d), "person_id")
    unnamed = c.filter("person_id % 2 = 0").select(F.col("person_id").alias("cluster_id"), F.lit(None).cast("long").alias("person_id"), "centroid")
    return clustering.absorb(c.filter("person_id = 11"), unnamed, 0.1).select("cluster_id", F.round("similarity", 6).alias("similarity"))


def _reach(pairs: str) -> str:
    """Reachability over pairs (a, b, ...): a set is named by its smallest member."""
    return f"""{pairs}, links AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs),
        reach AS (SELECT x AS m, x AS r FROM links UNION SELECT reach.m, links.y FROM reach JOIN links ON reach.r = links.x),
        sets AS (SELECT m AS member, min(r) AS set_id FROM reach GROUP BY m)"""


_FACE_PAIRS = f"pairs AS (SELECT a.face_id AS a, b.face_id AS b, {_DOT} AS s FROM vectors a JOIN vectors b ON a.label = b.label AND a.face_id < b.face_id WHERE {_DOT} >= {NEAR})"


@query(f"""{with_views("vectors")}, {_reach(_FACE_PAIRS)},
    closest AS (SELECT m AS member, max(s) AS c FROM (SELECT a AS m, s FROM pairs UNION ALL SELECT b, s FROM pairs) GROUP BY m),
    known AS (SELECT v.label AS person_id, set_id, member AS face_id, c, member % 3 = 0 AS confirmed, member % 50 AS face_px FROM sets JOIN closest USING (member) JOIN vectors v ON v.face_id = member)
    SELECT person_id, set_id, face_id, round(c, 6) AS closest, row_number() OVER (PARTITION BY set_id ORDER BY confirmed DESC, face_px DESC, face_id) AS rank,
    count(*) OVER (PARTITION BY set_id) AS size FROM known""")
def duplicate_faces(spark, d):
    v = tables.vectors(spark, d).select("face_id", F.col("label").cast("long").alias("person_id"), "vector")
    details = v.select("face_id", (F.col("face_id") % 3 == 0).alias("confirmed"), (F.col("face_id") % 50).alias("face_px"), F.lit(None).cast("double").alias("sharpness"), F.lit(1.0).alias("score"))
    found = duplicates.duplicate_faces(v, details, NEAR)
    return found.select(F.col("person_id").cast("int").alias("person_id"), "set_id", "face_id", F.round("closest", 6).alias("closest"), F.col("rank").cast("long").alias("rank"), "size")


_PERSON_PAIRS = "pairs AS (SELECT a.person_id AS a, b.person_id AS b, list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda z: z[1] * z[2])) AS s FROM centroids a JOIN centroids b ON a.person_id < b.person_id WHERE list_sum(list_transform(list_zip(a.centroid, b.centroid), lambda z: z[1] * z[2])) >= 0.3)"


@query(f"""{with_views("vectors", "centroids")}, {_reach(_PERSON_PAIRS)},
    counted AS (SELECT person_id, count(*) AS faces, count(DISTINCT face_id // 5) AS photos FROM vectors GROUP BY person_id)
    SELECT set_id, member AS person_id, photos, faces, row_number() OVER (PARTITION BY set_id ORDER BY photos DESC, faces DESC, member) AS rank, count(*) OVER (PARTITION BY set_id) AS size
    FROM sets JOIN counted ON person_id = member""")
def duplicate_people(spark, d):
    v = tables.vectors(spark, d).withColumn("person_id", F.col("person_id").cast("long"))
    counted = v.groupBy("person_id").agg(F.count("*").alias("faces"), F.count_distinct(F.expr("face_id div 5")).alias("photos")).withColumn("display_name", F.lpad(F.col("person_id").cast("string"), 9, "0"))
    found = duplicates.duplicate_people(vectors.unit_mean(v, "person_id").select("person_id", "centroid"), counted, 0.3)
    return found.select("set_id", "person_id", "photos", "faces", F.col("rank").cast("long").alias("rank"), "size")


_SIGNS = """bits AS (SELECT vec_id AS photo_id, embedding::DOUBLE[] AS e FROM embeddings),
    signs AS (SELECT photo_id, list_concat(list_transform(range(1, 65), lambda i: e[i] > e[i % 64 + 1]), list_transform(range(1, 65), lambda i: e[i] > list_sum(e) / 64)) AS h,
        list_transform(range(0, 36), lambda k: 4 * e[(k // 6 + 1) * 8 + k % 6 + 2] - e[(k // 6) * 8 + k % 6 + 2] - e[(k // 6 + 2) * 8 + k % 6 + 2] - e[(k // 6 + 1) * 8 + k % 6 + 1] - e[(k // 6 + 1) * 8 + k % 6 + 3]) AS lap FROM bits),
    signatures AS (SELECT photo_id, h, greatest(0.0, list_sum(list_transform(lap, lambda v: v * v)) / 36 - (list_sum(lap) / 36) * (list_sum(lap) / 36)) AS sharpness, ts AS taken FROM signs LEFT JOIN events ON event_id = photo_id)"""
_APART = "len(list_filter(list_zip(a.h, b.h), lambda z: z[1] <> z[2]))"


@query(f"""WITH RECURSIVE {_SIGNS} SELECT photo_id, array_to_string(list_transform(h, lambda b: CASE WHEN b THEN '1' ELSE '0' END), '') AS bits, round(sharpness, 6) AS sharpness FROM signatures""")
def signature_hash(spark, d):
    s = tables.signatures(spark, d)

    def word(c):
        return F.reverse(F.lpad(F.bin(c), 64, "0"))

    return s.select("photo_id", F.concat(word("gradient"), word("brightness")).alias("bits"), F.round("sharpness", 6).alias("sharpness"))


#: Pictures here are far apart, so the queries' radius is wider than the library's 12 bits.
_BITS, _SECONDS = 40, 5 * 24 * 3600


@query(f"""WITH RECURSIVE {_SIGNS}, {_reach(f"pairs AS (SELECT a.photo_id AS a, b.photo_id AS b, {_APART} AS s FROM signatures a JOIN signatures b ON a.photo_id < b.photo_id WHERE {_APART} <= {_BITS} AND (a.taken IS NULL OR b.taken IS NULL OR abs(epoch_us(a.taken) - epoch_us(b.taken)) <= {_SECONDS}000000))")},
    members AS (SELECT set_id, s.* FROM sets JOIN signatures s ON photo_id = member),
    best AS (SELECT set_id AS best_set, h AS best_h FROM members QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY round(sharpness, 12) DESC, photo_id) = 1)
    SELECT set_id, photo_id, row_number() OVER (PARTITION BY set_id ORDER BY round(sharpness, 12) DESC, taken, photo_id) AS rank, count(*) OVER (PARTITION BY set_id) AS size,
    len(list_filter(list_zip(h, best_h), lambda z: z[1] <> z[2])) AS distance_from_best FROM members JOIN best ON set_id = best_set""")
def duplicate_photos(spark, d):
    s = tables.signatures(spark, d).withColumns({"sharpness": F.round("sharpness", 12), "taken_utc": F.col("taken_utc").cast("timestamp"), "file_size": F.lit(1), "mtime_utc": F.lit(None).cast("timestamp")})
    found = duplicates.duplicate_photos(s, _BITS, _SECONDS)
    return found.select("set_id", "photo_id", F.col("rank").cast("long").alias("rank"), "size", F.col("distance_from_best").cast("long").alias("distance_from_best"))


@query(f"""WITH RECURSIVE {_SIGNS}, {_reach(f"pairs AS (SELECT a.photo_id AS a, b.photo_id AS b FROM signatures a JOIN signatures b ON a.photo_id < b.photo_id AND a.photo_id % 3 = b.photo_id % 3 WHERE {_APART} <= {_BITS} AND abs(epoch_us(a.taken) - epoch_us(b.taken)) <= {_SECONDS}000000)")}
    SELECT CAST(set_id % 3 AS VARCHAR) AS key, set_id AS burst_id, epoch_us(min(taken)) AS first_us, epoch_us(max(taken)) AS last_us, count(*) AS n FROM sets JOIN signatures ON photo_id = member GROUP BY set_id""")
def alike_bursts(spark, d):
    s = tables.signatures(spark, d).select("photo_id", (F.col("photo_id") % 3).cast("string").alias("key"), F.col("taken_utc").cast("timestamp").alias("ts"), "gradient", "brightness")
    found = picture_bursts.picture_bursts(s, _BITS, _SECONDS)
    return found.select("key", "burst_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query(f"""WITH RECURSIVE {_SIGNS}, {_reach(f"pairs AS (SELECT a.photo_id AS a, b.photo_id AS b FROM signatures a JOIN signatures b ON a.photo_id < b.photo_id WHERE {_APART} <= {_BITS})")},
    ranked AS (SELECT set_id, member, member + 100 AS bytes, row_number() OVER (PARTITION BY set_id ORDER BY member) AS rank FROM sets),
    totals AS (SELECT set_id, count(*) AS size, CAST(sum((rank > 1)::INT) AS BIGINT) AS extras, CAST(sum(CASE WHEN rank > 1 THEN bytes ELSE 0 END) AS BIGINT) AS recoverable FROM ranked GROUP BY set_id)
    SELECT *, row_number() OVER (ORDER BY size DESC, recoverable DESC, set_id) AS set_rank FROM totals""")
def duplicate_set_totals(spark, d):
    pairs = duplicates.hash_pairs(tables.signatures(spark, d), _BITS)
    ranked = duplicates.rank_members(duplicates.sets_of(pairs), "member").withColumn("file_size", F.col("member") + 100)
    return duplicates.set_totals(ranked).withColumn("set_rank", F.col("set_rank").cast("long"))


@query()
def cluster_faces(spark, d):
    """Label propagation is sequential and seeded: tests hold its invariants."""
    return clustering.cluster_faces(tables.vectors(spark, d), least=NEAR)


@query("""WITH boxes AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS x, l_quantity / 2 AS y, 10 + l_quantity AS w, 20.0 AS h, l_extendedprice AS p FROM lineitem),
    pairs AS (SELECT a.k, a.n AS n1, b.n AS n2, a.p AS p1, b.p AS p2, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared,
        a.w * a.h + b.w * b.h AS areas FROM boxes a JOIN boxes b ON a.k = b.k AND a.p < b.p)
    SELECT k, n1, n2, p1, p2, round(shared / (areas - shared), 6) AS iou FROM pairs WHERE shared > 0""")
def box_iou_pairs(spark, d):
    return _iou_pairs(tables.raw(spark, d, "lineitem"))


def _iou_pairs(li):
    q = F.col("l_quantity")
    boxes = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("p"), G.box(q, q / 2, q + 10, F.lit(20.0)).alias("b"))
    a, b = (boxes.select("k", *[F.col(c).alias(f"{c}{i}") for c in ("n", "p", "b")]) for i in (1, 2))
    pairs = a.join(b, "k").filter("p1 < p2").withColumn("iou", G.iou(F.col("b1"), F.col("b2")))
    return pairs.filter("iou > 0").select("k", "n1", "n2", "p1", "p2", F.round("iou", 6).alias("iou"))


@query()
def nms(spark, d):
    """Greedy suppression is sequential within an image: tests hold it against fixed cases."""
    li = tables.raw(spark, d, "lineitem")
    numbered = li.select(F.col("l_orderkey").alias("photo_id"), F.xxhash64("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("box_id"), F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"), F.col("l_extendedprice").alias("score"))
    return imaging.non_maximum_suppression(numbered, "photo_id", 0.3)


@query("""WITH sides AS (SELECT DISTINCT 64 * (1 + p_size % 5) AS side FROM part)
    SELECT side, stride, y * (side // stride) * 2 + x * 2 + a AS anchor, CAST(x * stride AS DOUBLE) AS cx, CAST(y * stride AS DOUBLE) AS cy
    FROM sides, (SELECT unnest([8, 16, 32]) AS stride), LATERAL (SELECT unnest(range(side // stride)) AS y), LATERAL (SELECT unnest(range(side // stride)) AS x), (SELECT unnest([0, 1]) AS a)""")
def anchor_centres(spark, d):
    """The anchors of all inputs of the sizes that parts ask for."""
    sides = tables.raw(spark, d, "part").select((64 * (1 + F.col("p_size") % 5)).cast("int").alias("side")).distinct()
    strides = sides.select("side", F.explode(F.array(F.lit(8), F.lit(16), F.lit(32))).alias("stride"))
    cells = (F.col("side") / F.col("stride")).cast("int")
    rows = strides.select("side", "stride", cells.alias("cells"), F.explode(F.sequence(F.lit(0), cells - 1)).alias("y"))
    grid = rows.select("side", "stride", "cells", "y", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("x"))
    both = grid.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("a"))
    anchor = (F.col("y") * F.col("cells") + F.col("x")) * 2 + F.col("a")
    return both.select("side", "stride", anchor.cast("long").alias("anchor"), (F.col("x") * F.col("stride")).cast("double").alias("cx"), (F.col("y") * F.col("stride")).cast("double").alias("cy"))


@query("""WITH p AS (SELECT vec_id, unnest(range(5)) AS i, embedding::DOUBLE[] AS e FROM embeddings),
    q AS (SELECT vec_id, e[2 * i + 1] AS x, e[2 * i + 2] AS y, [38.2946, 73.5318, 56.0252, 41.5493, 70.7299][i + 1]::DOUBLE AS u, [51.6963, 51.5014, 71.7366, 92.3655, 92.2041][i + 1]::DOUBLE AS v FROM p),
    m AS (SELECT vec_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM q GROUP BY vec_id),
    s AS (SELECT vec_id, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) AS c, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) AS s FROM q JOIN m USING (vec_id) GROUP BY vec_id)
    SELECT vec_id, round(c, 4) AS m11, round(-s, 4) AS m12, round(s, 4) AS m21, round(mu - (c * mx - s * my), 4) AS dx, round(mv - (s * mx + c * my), 4) AS dy FROM s JOIN m USING (vec_id)""")
def similarity_fit(spark, d):
    template = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in G.ALIGNED_112])
    e = tables.raw(spark, d, "embeddings").select("vec_id", "embedding", F.posexplode(template).alias("i", "t"))
    points = e.select("vec_id", F.get("embedding", 2 * F.col("i")).cast("double").alias("x"), F.get("embedding", 2 * F.col("i") + 1).cast("double").alias("y"), F.col("t.u").alias("u"), F.col("t.v").alias("v"))
    fit = imaging.similarity_sums(points, "vec_id")
    return fit.select("vec_id", *[F.round(c, 4).alias(c) for c in ("m11", "m12", "m21", "dx", "dy")])


@query("""SELECT p_partkey, round(s, 6) AS scale, CAST(640 - least(640, round_even(w * s, 0)) AS INT) AS pad_x, CAST(640 - least(640, round_even(h * s, 0)) AS INT) AS pad_y
    FROM (SELECT *, least(640.0::DOUBLE / w, 640.0::DOUBLE / h) AS s FROM (SELECT p_partkey, p_size * 37 + 100 AS w, p_size * 11 + p_partkey % 900 + 1 AS h FROM part))""")
def letterbox_fit(spark, d):
    p = tables.raw(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 100).alias("w"), (F.col("p_size") * 11 + F.col("p_partkey") % 900 + 1).alias("h"))
    fit = p.select("p_partkey", G.letterbox(F.col("w"), F.col("h"), 640).alias("f"))
    return fit.select("p_partkey", F.round("f.scale", 6).alias("scale"), F.col("f.pad_x").alias("pad_x"), F.col("f.pad_y").alias("pad_y"))


@query(f"""{with_views("vectors")}, members AS (SELECT person_id AS cluster_id, count(*) AS n FROM vectors WHERE face_id % 3 <> 0 OR label > 2 GROUP BY person_id),
    kept AS (SELECT * FROM vectors WHERE face_id % 3 <> 0 OR label > 2),
    near AS (SELECT a.person_id AS cluster_id, a.face_id, coalesce(sum(CASE WHEN a.face_id <> b.face_id THEN {_DOT} END), 0.0) AS score FROM kept a JOIN kept b ON a.person_id = b.person_id GROUP BY a.person_id, a.face_id),
    fresh AS (SELECT cluster_id, face_id AS medoid FROM near QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 9) DESC, face_id) = 1),
    clusters AS (SELECT person_id AS cluster_id, count(*) AS size, min(face_id) AS medoid_face_id FROM vectors GROUP BY person_id)
    SELECT c.cluster_id, coalesce(n, 0) AS size, medoid AS medoid_face_id, CASE WHEN n IS NULL THEN 'removed' WHEN size = n AND medoid_face_id = medoid THEN 'kept' ELSE 'fixed' END AS action
    FROM clusters c LEFT JOIN members m ON c.cluster_id = m.cluster_id LEFT JOIN fresh f ON c.cluster_id = f.cluster_id""")
def repair_clusters(spark, d):
    v = tables.vectors(spark, d).withColumnRenamed("person_id", "cluster_id")
    clusters = v.groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("face_id").alias("medoid_face_id"))
    kept = v.filter("face_id % 3 <> 0 or label > 2")
    return people.repair_clusters(clusters, kept, vectors.medoid(kept, "cluster_id"))
