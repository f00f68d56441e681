"""Registered queries of column functions and of actions end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlight.functions import geometry as G
from kinlight.functions import hashing as H
from kinlight.functions import text as T
from kinlight.operators import clustering, duplicates, exports, lookups, maintenance, people, workflows
from kinlight.plans.registry import query, with_views
from kinlight.sources import sinks, tables

_BOXES = "boxes AS (SELECT l_orderkey AS k, l_linenumber AS n, l_quantity - 5 AS x, l_quantity / 2 AS y, 10 + l_quantity AS w, 20.0::DOUBLE AS h, 1 + l_discount * 10 AS s FROM lineitem)"


def _boxes(spark, d):
    q = F.col("l_quantity")
    return tables.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), G.box(q - 5, q / 2, q + 10, F.lit(20.0)).alias("b"), (1 + F.col("l_discount") * 10).alias("s"))


def _flat(rows, *keys):
    """A box as rounded columns."""
    return rows.select(*keys, *[F.round(F.col("b")[c], 6).alias(c) for c in ("x", "y", "w", "h")])


@query(f"""WITH {_BOXES}, corners AS (SELECT k, n, greatest(0, x - w * 0.25) AS x1, greatest(0, y - h * 0.25) AS y1, least(50, x + w * 1.25) AS x2, least(30, y + h * 1.25) AS y2 FROM boxes)
    SELECT k, n, round(x1, 6) AS x, round(y1, 6) AS y, round(greatest(0, x2 - x1), 6) AS w, round(greatest(0, y2 - y1), 6) AS h FROM corners""")
def box_expand(spark, d):
    return _flat(_boxes(spark, d).withColumn("b", G.expand(F.col("b"), 0.25, F.lit(50), F.lit(30))), "k", "n")


@query(f"""WITH {_BOXES}, r AS (SELECT *, CASE WHEN s >= 1.5 THEN 1 ELSE s / 2 END AS f FROM boxes)
    SELECT k, n, round(x / f, 6) AS x, round(y / f, 6) AS y, round(w / f, 6) AS w, round(h / f, 6) AS h FROM r""")
def box_rescale(spark, d):
    scale = F.when(F.col("s") >= 1.5, 1.0).otherwise(F.col("s") / 2)
    return _flat(_boxes(spark, d).withColumn("b", G.rescale(F.col("b"), scale)), "k", "n")


@query(f"""WITH {_BOXES}, c AS (SELECT k, n, greatest(0, floor(x * 0.5)) AS x1, greatest(0, floor(y * 2.0)) AS y1, least(20, ceil((x + w) * 0.5)) AS x2, least(60, ceil((y + h) * 2.0)) AS y2 FROM boxes)
    SELECT k, n, CASE WHEN x2 > x1 AND y2 > y1 THEN x1::BIGINT END AS x, CASE WHEN x2 > x1 AND y2 > y1 THEN y1::BIGINT END AS y,
    CASE WHEN x2 > x1 AND y2 > y1 THEN (x2 - x1)::BIGINT END AS w, CASE WHEN x2 > x1 AND y2 > y1 THEN (y2 - y1)::BIGINT END AS h FROM c""")
def box_crop(spark, d):
    crop = G.crop_region(F.col("b"), F.lit(0.5), F.lit(2.0), F.lit(20), F.lit(60))
    return _boxes(spark, d).select("k", "n", crop.alias("c")).select("k", "n", "c.x", "c.y", "c.w", "c.h")


@query(f"""WITH {_BOXES} SELECT k, n, round(x + w / 2, 6) AS cx, round(y + h / 2, 6) AS cy, round(w * h, 4) AS area, round_even(least(w, h), 0)::INT AS px,
    round(sqrt((w / 2) ** 2 + (h / 2) ** 2), 6) AS corner, round((x + 3) * s, 6) AS moved FROM boxes""")
def box_measures(spark, d):
    b = F.col("b")
    corner = F.struct(b["x"].alias("x"), b["y"].alias("y"))
    rows = _boxes(spark, d).withColumns({"c": G.centre(b), "m": G.scale_point(G.translate(corner, F.lit(3.0), F.lit(0.0)), F.col("s"))})
    return rows.select("k", "n", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), F.round(G.area(b), 4).alias("area"), G.face_px(b).alias("px"), F.round(G.distance(F.col("c"), corner), 6).alias("corner"), F.round("m.x", 6).alias("moved"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS m FROM embeddings)
    SELECT vec_id, round(sqrt((m[1] - m[3]) ** 2 + (m[2] - m[4]) ** 2), 6) AS eyes, m[1] < m[3] AND m[7] < m[9] AND (m[2] + m[4]) / 2 < (m[8] + m[10]) / 2 AS ordered FROM e""")
def landmark_checks(spark, d):
    e = tables.raw(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("m"))
    return e.select("vec_id", F.round(G.interocular(F.col("m")), 6).alias("eyes"), G.plausibly_ordered(F.col("m")).alias("ordered"))


@query("""WITH p AS (SELECT p_partkey, p_size * 37 + 100 AS w, p_size * 11 + p_partkey % 900 + 1 AS h, (p_partkey % 10)::INT AS o FROM part)
    SELECT p_partkey, round(CASE WHEN greatest(w, h) <= 800 THEN 1.0 ELSE 800.0 / greatest(w, h) END::DOUBLE, 6) AS factor, CASE WHEN o IN (5, 6, 7, 8) THEN h ELSE w END AS width, CASE WHEN o IN (5, 6, 7, 8) THEN w ELSE h END AS height FROM p""")
def image_sizes(spark, d):
    p = tables.raw(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 100).cast("long").alias("w"), (F.col("p_size") * 11 + F.col("p_partkey") % 900 + 1).alias("h"), (F.col("p_partkey") % 10).cast("int").alias("o"))
    sized = p.withColumn("u", G.upright_size(F.col("w"), F.col("h"), F.col("o")))
    return sized.select("p_partkey", F.round(G.downscale(F.col("w"), F.col("h"), 800), 6).alias("factor"), F.col("u.width").alias("width"), F.col("u.height").alias("height"))


@query("""WITH a AS (SELECT p_partkey, p_size, [8, 16, 32][p_partkey % 3 + 1] AS stride FROM part),
    n AS (SELECT *, 640 // stride AS cells, p_partkey % (2 * (640 // stride) * (640 // stride)) AS anchor FROM a),
    c AS (SELECT *, (anchor // 2 % cells * stride)::DOUBLE AS cx, (anchor // 2 // cells * stride)::DOUBLE AS cy FROM n)
    SELECT p_partkey, stride, anchor, cx, cy, cx - p_size AS left_x, cy - p_size / 2 AS top_y, (2 * p_size + 1)::DOUBLE AS w, p_size / 2 + p_size + 3 AS h FROM c""")
def anchor_boxes(spark, d):
    """The box that each part's sizes, as distances from an anchor of the detector's head, make."""
    p = tables.raw(spark, d, "part").withColumn("stride", F.get(F.array(F.lit(8), F.lit(16), F.lit(32)), (F.col("p_partkey") % 3).cast("int")))
    cells = (F.lit(640) / F.col("stride")).cast("long")
    anchors = p.withColumn("anchor", F.col("p_partkey") % (2 * cells * cells))
    cell = F.floor(F.col("anchor") / 2)
    centred = anchors.withColumns({"cx": (cell % cells * F.col("stride")).cast("double"), "cy": (F.floor(cell / cells) * F.col("stride")).cast("double")})
    size = F.col("p_size").cast("double")
    found = centred.withColumn("b", G.distance_box(F.col("cx"), F.col("cy"), size, size / 2, size + 1, size + 3))
    return found.select("p_partkey", "stride", "anchor", "cx", "cy", F.col("b.x").alias("left_x"), F.col("b.y").alias("top_y"), "b.w", "b.h")


@query(f"""WITH e AS (SELECT doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)
    SELECT doc_id, upper(sha256(encode(n::VARCHAR || ':') || unhex(substr(hex(t), 1, {2 * H.SAMPLE_BYTES})) || CASE WHEN n > {H.SAMPLE_BYTES} THEN unhex(right(hex(t), {2 * H.SAMPLE_BYTES})) ELSE ''::BLOB END)) AS digest FROM e""")
def content_digests(spark, d):
    docs = tables.raw(spark, d, "documents")
    return docs.select("doc_id", H.content_hash(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


@query("""SELECT event_id, upper(lpad(format('{:x}', event_id * 1000003), 16, '0')) || upper(lpad(format('{:x}', user_id), 16, '0')) AS hex FROM events""")
def hash_digits(spark, d):
    e = tables.raw(spark, d, "events")
    return e.select("event_id", H.hash_hex(F.col("event_id") * 1000003, F.col("user_id")).alias("hex"))


@query(f"""{with_views("photos")} SELECT photo_id,
    CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.0f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.0f KB', b / 1024.0) ELSE b || ' bytes' END AS short,
    printf('%.0f%%', 100.0 * (photo_id % 7) / 7) AS share, (photo_id % 3) || CASE WHEN photo_id % 3 = 1 THEN ' photo' ELSE ' photos' END AS counted,
    CASE WHEN photo_id % 4 > 0 THEN least((photo_id % 8) / (photo_id % 4), 1.0)::DOUBLE END AS progress
    FROM (SELECT photo_id, file_size * (1 + photo_id % 97) + 1 AS b FROM photos)""")
def display_texts(spark, d):
    p = tables.photos(spark, d)
    i = F.col("photo_id")
    return p.select("photo_id", T.byte_size_short(F.col("file_size") * (1 + i % 97) + 1).alias("short"), T.percentage((i % 7) / 7).alias("share"), T.counted(i % 3, "photo", "photos").alias("counted"), T.progress(i % 8, i % 4).alias("progress"))


@query("""SELECT greatest(max(p_size), 0) AS version FROM part""")
def schema_version(spark, d):
    return maintenance.version_of(tables.raw(spark, d, "part").select(F.col("p_size").alias("version")))


@query(f"""{with_views("vectors")} SELECT face_id, coalesce(label::DOUBLE, 0.5::DOUBLE) AS weight FROM vectors v LEFT JOIN (SELECT face_id AS f, label FROM vectors WHERE face_id % 2 = 0) x ON v.face_id = x.f""".replace("coalesce(label", "coalesce(x.label"))
def default_values(spark, d):
    v = tables.vectors(spark, d)
    known = v.filter("face_id % 2 = 0").select("face_id", F.col("label").cast("double").alias("weight"))
    return lookups.with_default(v.select("face_id"), known, "face_id", "weight", 0.5)


@query(f"""{with_views("vectors")}, links AS (SELECT face_id + 1 AS a, face_id AS b FROM vectors WHERE face_id % 3 = 0) SELECT b AS a, a AS b FROM links WHERE a IN (SELECT face_id FROM vectors)""")
def face_constraints(spark, d):
    v = tables.vectors(spark, d)
    links = v.select((F.col("face_id") + 1).alias("face_a"), F.col("face_id").alias("face_b"), (F.col("face_id") % 3).cast("int").alias("kind"))
    return clustering.map_constraints(links, v, 0)


@query(f"""{with_views("faces")} SELECT photo_id, count(*) AS n FROM faces WHERE assignment IN (1, 2) GROUP BY photo_id""")
def decided_faces(spark, d):
    return tables.faces(spark, d).filter(lookups.user_decided()).groupBy("photo_id").agg(F.count("*").alias("n"))


# --- hashes within the library's own radius ----------------------------------------------------------------

_NEAR = """WITH h AS (SELECT vec_id AS id, hash(vec_id) AS junk, (vec_id * 2654435761 + 97 * vec_id * vec_id) AS g, (vec_id * 40503 + vec_id * vec_id * vec_id) AS b FROM embeddings),
    hashes AS (SELECT id, g, b FROM h UNION ALL SELECT id + 1000000, xor(g, 5 + 1024 * (id % 2)), xor(b, 7 * (id % 3)) FROM h)"""


def _near_hashes(spark, d):
    i = F.col("vec_id")
    h = tables.raw(spark, d, "embeddings").select(i.alias("photo_id"), (i * 2654435761 + 97 * i * i).alias("gradient"), (i * 40503 + i * i * i).alias("brightness"))
    p = F.col("photo_id")
    copies = h.select((p + 1_000_000).alias("photo_id"), F.col("gradient").bitwiseXOR(5 + 1024 * (p % 2)).alias("gradient"), F.col("brightness").bitwiseXOR(7 * (p % 3)).alias("brightness"))
    return h.unionByName(copies)


@query(f"""{_NEAR} SELECT x.id AS a, y.id AS b, (bit_count(xor(x.g, y.g)) + bit_count(xor(x.b, y.b)))::INT AS distance FROM hashes x JOIN hashes y ON x.id < y.id WHERE bit_count(xor(x.g, y.g)) + bit_count(xor(x.b, y.b)) <= 12""")
def near_hashes(spark, d):
    return duplicates.hash_pairs(_near_hashes(spark, d))


# --- actions end to end ------------------------------------------------------------------------------------


def _library(spark, d):
    """People and groups from the embeddings' labels: every group of ten vectors' numbers, named where even."""
    v = tables.vectors(spark, d)
    faces = v.select("face_id", F.when(F.col("person_id") % 2 == 0, F.col("person_id")).cast("long").alias("person_id"), F.col("person_id").cast("long").alias("cluster_id"), F.when(F.col("face_id") % 5 == 0, 1).otherwise(0).alias("assignment"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.lit(50.0).alias("min_side"), F.lit(0.9).alias("score"))
    persons = faces.filter("person_id is not null").select("person_id").distinct().select("person_id", F.concat(F.lit("P"), F.col("person_id").cast("string")).alias("display_name"), F.lit(None).cast("long").alias("cover_face_id"), F.lit(None).cast("array<double>").alias("centroid"))
    clusters = faces.groupBy("cluster_id").agg(F.max("person_id").alias("person_id"), F.count("*").alias("size"), F.min("face_id").alias("medoid_face_id"))
    return workflows.Library(persons, faces, clusters)


_LIBRARY = f"""{with_views("vectors")}, f AS (SELECT face_id, CASE WHEN person_id % 2 = 0 THEN person_id END AS person_id, person_id AS cluster_id, CASE WHEN face_id % 5 = 0 THEN 1 ELSE 0 END AS assignment FROM vectors)"""


def _named(least: float) -> str:
    """A group's free faces get the new person, and so do those of unnamed groups whose mean is near enough to theirs."""
    return f"""{_LIBRARY}, parts AS (SELECT cluster_id, assignment, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM f JOIN vectors USING (face_id) WHERE cluster_id % 2 = 1),
    sums AS (SELECT cluster_id, pos, sum(x) AS s, sum(x) FILTER (assignment = 0) AS o FROM parts GROUP BY cluster_id, pos),
    own AS (SELECT pos, o / (SELECT sqrt(sum(o * o)) FROM sums WHERE cluster_id = 11) AS o FROM sums WHERE cluster_id = 11),
    near AS (SELECT cluster_id FROM sums JOIN own USING (pos) GROUP BY cluster_id HAVING sum(s * own.o) / sqrt(sum(s * s)) >= {least} OR cluster_id = 11)
    SELECT face_id, CASE WHEN cluster_id IN (FROM near) AND assignment = 0 THEN 9000 ELSE person_id END AS person_id FROM f"""


@query(_named(0.15))
def name_group(spark, d):
    """A group is named, and absorbs the few that look much like it."""
    return workflows.name_group(_library(spark, d), 11, "Ann", 9000, least=0.15)[0].faces.select("face_id", "person_id")


@query(_named(-0.05))
def name_group_absorbing(spark, d):
    """At a lower similarity more unnamed groups are absorbed; decided faces stay."""
    return workflows.name_group(_library(spark, d), 11, "Ann", 9000, least=-0.05)[0].faces.select("face_id", "person_id")


@query(f"""{_LIBRARY}, m AS (SELECT face_id, CASE WHEN person_id IN (2, 4) THEN 6 ELSE person_id END AS person_id FROM f),
    parts AS (SELECT m.person_id, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM m JOIN vectors USING (face_id) WHERE m.person_id IS NOT NULL),
    sums AS (SELECT person_id, pos, sum(x) AS s FROM parts WHERE person_id = 6 GROUP BY person_id, pos) SELECT person_id, pos, round(s / (SELECT sqrt(sum(s * s)) FROM sums), 6) AS value FROM sums""")
def merge_calibrated(spark, d):
    """The merged person's fresh centroid."""
    now = workflows.merge_people(_library(spark, d), 6, [2, 4])[0]
    found = now.persons.filter("person_id = 6").select("person_id", F.posexplode("centroid").alias("pos", "value"))
    return found.select("person_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"""{_LIBRARY}, parts AS (SELECT f.person_id, unnest(vector) AS x, unnest(range(len(vector))) AS pos FROM f JOIN vectors USING (face_id) WHERE f.person_id IS NOT NULL),
    sums AS (SELECT person_id, pos, sum(x) AS s FROM parts GROUP BY person_id, pos),
    means AS (SELECT person_id, list(s / l ORDER BY pos) AS c, max(s / l) AS most FROM sums JOIN (SELECT person_id, sqrt(sum(s * s)) AS l FROM sums GROUP BY person_id) USING (person_id) GROUP BY person_id),
    near AS (SELECT f.person_id, face_id, most, list_sum(list_transform(list_zip(vector, c), lambda z: z[1] * z[2])) AS s FROM f JOIN vectors USING (face_id) JOIN means ON means.person_id = f.person_id)
    SELECT person_id, face_id AS cover_face_id, round(most, 6) AS most, (SELECT count(DISTINCT person_id) FROM f) AS people FROM near QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY round(s, 9) DESC, face_id) = 1""")
def repair_counts(spark, d):
    """Everybody's cover and centroid after a repair, by its largest value, and how many people were calibrated."""
    now, outcome = workflows.repair(_library(spark, d))
    return now.persons.select("person_id", "cover_face_id", F.round(F.array_max("centroid"), 6).alias("most"), F.lit(outcome["people"]).cast("long").alias("people"))


@query(f"""{with_views("vectors")} SELECT count(*) AS restored, 0::BIGINT AS remain FROM vectors WHERE person_id = 11""")
def restore_ignored(spark, d):
    v = tables.vectors(spark, d).select("face_id", F.col("person_id").alias("cluster_id"))
    left, n = people.restore_ignored(people.ignore_cluster(v, v.limit(0), 11)[1])
    return left.agg(F.lit(n).cast("long").alias("restored"), F.count("*").alias("remain"))


@query("""SELECT * FROM (VALUES ('/lib/12/out', 'inside_root'), ('/elsewhere', 'no_space'), ('/quarantine', 'ok')) t(folder, outcome)""")
def guarded_plans(spark, d):
    p = tables.photos(spark, d)
    roots = spark.createDataFrame([("/lib/12",), ("/lib/7",)], "path string")
    plan = p.select("photo_id", F.col("file_size").alias("bytes"))
    rows = [(f, exports.checked(plan, roots, f, free)[1]) for f, free in (("/lib/12/out", None), ("/elsewhere", 1), ("/quarantine", None))]
    return spark.createDataFrame(rows, "folder string, outcome string")


@query(f"""{with_views("photos", "faces")} SELECT photo_id, count(*) AS n FROM faces WHERE photo_id NOT IN (SELECT photo_id FROM photos WHERE photo_id % 4 = 1) GROUP BY photo_id""")
def forget_moved(spark, d):
    store = {"photos": tables.photos(spark, d).withColumnRenamed("photo_id", "id"), "faces": tables.faces(spark, d).withColumn("id", F.col("cluster_id"))}
    outcome = store["photos"].select("id", (F.col("id") % 4).cast("int").alias("status"))
    return exports.forget_moved(store, outcome)["faces"].groupBy("photo_id").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey AS id, max(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey""")
def upsert_repeated(spark, d):
    """Several changes to a key: the last one, here the largest, counts."""
    li = tables.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("quantity"))
    return sinks.upsert(li.limit(0), li, ["id"], ["quantity"])
