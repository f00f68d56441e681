"""Registered queries: scans, lookups, queues, joins, aggregates, search and sorting."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.functions import text as T
from kinlight.operators import duplicates, lookups, maintenance, people, search
from kinlight.operators.text_index import TextIndex
from kinlight.plans.lineage import checkpoint_dir, cut, remove_folder
from kinlight.plans.numbering import numbered
from kinlight.plans.registry import query, with_views
from kinlight.sources import tables
from kinlight.streaming import incremental

_TOP2 = "top AS (SELECT person_id FROM appear GROUP BY person_id ORDER BY count(*) DESC, person_id LIMIT 2)"


def _two_people(spark: SparkSession, d: str) -> list[int]:
    """The two people who are in most photos."""
    appear = search.appearances(tables.faces(spark, d))
    most = appear.groupBy("person_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "person_id").limit(2)
    return [r.person_id for r in most.collect()]


def _hits(found: DataFrame) -> DataFrame:
    return found.select("photo_id", "path", F.date_format("taken_utc", "yyyy-MM-dd").alias("taken"), "names", F.col("position").cast("long").alias("position"), "total", "truncated")


def _hits_sql(matched: str, ctes: str = "") -> str:
    return f"""{with_views("photos", "faces", "persons", "appear")}{ctes}, matched AS ({matched}),
        top AS (SELECT *, row_number() OVER (ORDER BY taken_utc DESC, lower(path), photo_id) AS position, count(*) OVER () AS total FROM matched),
        named AS (SELECT photo_id, string_agg(DISTINCT display_name, ', ' ORDER BY display_name) AS names FROM appear JOIN persons USING (person_id) GROUP BY photo_id)
        SELECT photo_id, path, strftime(taken_utc, '%Y-%m-%d') AS taken, coalesce(names, '') AS names, position, total, total > 500 AS truncated
        FROM top LEFT JOIN named USING (photo_id) WHERE position <= 500"""


_PAIR = ", chosen AS (SELECT person_id FROM appear GROUP BY person_id ORDER BY count(*) DESC, person_id LIMIT 2)"


@query(_hits_sql("SELECT * FROM photos WHERE photo_id IN (SELECT photo_id FROM appear WHERE person_id IN (FROM chosen) GROUP BY photo_id HAVING count(*) = 2)", _PAIR))
def search_all_people(spark, d):
    return _hits(search.search(tables.photos(spark, d), tables.faces(spark, d), tables.persons(spark, d), _two_people(spark, d)))


@query(_hits_sql("SELECT * FROM photos WHERE photo_id IN (SELECT photo_id FROM appear WHERE person_id IN (FROM chosen))", _PAIR))
def search_any_people(spark, d):
    return _hits(search.search(tables.photos(spark, d), tables.faces(spark, d), tables.persons(spark, d), _two_people(spark, d), match_all=False))


@query(_hits_sql("SELECT * FROM photos WHERE contains(lower(path), 'img_1')"))
def search_text_literal(spark, d):
    return _hits(search.search(tables.photos(spark, d), tables.faces(spark, d), tables.persons(spark, d), text="IMG_1"))


@query(f"""{with_views("photos")} SELECT photo_id, path FROM photos WHERE contains(lower(path), 'img_12')""")
def search_text_indexed(spark, d):
    folder = f"{checkpoint_dir(spark)}/text-index-{uuid.uuid4().hex}"
    photos = tables.photos(spark, d)
    try:
        index = TextIndex(spark, folder)
        index.add(photos, "photo_id", "path")
        return cut(index.search(photos, "photo_id", "path", "IMG_12").select("photo_id", "path"))
    finally:
        remove_folder(spark, folder)


@query(_hits_sql("SELECT * FROM photos WHERE contains(lower(regexp_extract(path, '[^/]*$')), '_1') AND photo_id IN (SELECT photo_id FROM appear WHERE person_id IN (FROM chosen))", _PAIR))
def search_people_and_text(spark, d):
    return _hits(search.search(tables.photos(spark, d), tables.faces(spark, d), tables.persons(spark, d), _two_people(spark, d), match_all=False, text="_1"))


@query(f"""{with_views("photos")} SELECT photo_id, path, file_size, camera, state FROM photos WHERE photo_id = 7""")
def photo_by_id(spark, d):
    return lookups.by_id(tables.photos(spark, d), 7, "photo_id").select("photo_id", "path", "file_size", "camera", "state")


@query(f"""{with_views("persons")} SELECT * FROM persons WHERE lower(display_name) = 'supplier#000000005'""")
def person_by_name(spark, d):
    return lookups.by_text(tables.persons(spark, d), "display_name", "SUPPLIER#000000005")


@query(f"""{with_views("photos")} SELECT photo_id, path FROM photos WHERE contains(lower(path), 'img_12') ORDER BY path LIMIT 50""")
def search_path(spark, d):
    return lookups.search_path(tables.photos(spark, d), "Img_12", 50).select("photo_id", "path")


@query(f"""{with_views("photos")} SELECT photo_id, state FROM photos WHERE state = 2 ORDER BY photo_id LIMIT 200""")
def photos_by_state(spark, d):
    return lookups.by_state(tables.photos(spark, d), 2, 200).select("photo_id", "state")


@query(f"""{with_views("faces")} SELECT photo_id, person_id, bbox_w, det_score + 0.0 AS det_score FROM faces WHERE person_id = 3 AND detector_id = 'O' AND active""")
def faces_of_person(spark, d):
    return lookups.of_person(tables.faces(spark, d), 3, "O").select("photo_id", "person_id", "bbox_w", "det_score")


@query(f"""{with_views("faces")} SELECT photo_id, person_id, active FROM faces WHERE photo_id = 32 AND detector_id = 'O'""")
def faces_of_photo(spark, d):
    return lookups.of_photo(tables.faces(spark, d), 32, "O").select("photo_id", "person_id", "active")


@query(f"""{with_views("faces")} SELECT photo_id, cluster_id, active FROM faces WHERE cluster_id = 11""")
def faces_of_cluster(spark, d):
    return lookups.of_cluster(tables.faces(spark, d), 11).select("photo_id", "cluster_id", "active")


@query(f"""{with_views("photos")} SELECT photo_id, path FROM photos WHERE photo_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)""")
def photos_by_ids(spark, d):
    ids = tables.faces(spark, d).filter("bbox_w >= 49").select("photo_id")
    return lookups.by_ids(tables.photos(spark, d), ids, "photo_id").select("photo_id", "path")


@query(f"""{with_views("vectors")} SELECT face_id, len(vector) AS dims, round(list_sum(list_transform(vector, lambda x: x * x)), 6) AS norm2 FROM vectors WHERE face_id = 42""")
def vector_by_id(spark, d):
    from kinlight.functions.vectors import dot

    return lookups.by_id(tables.vectors(spark, d), 42, "face_id").select("face_id", F.size("vector").cast("long").alias("dims"), F.round(dot("vector", "vector"), 6).alias("norm2"))


def _detections(spark, d):
    """Detection records exist for photos with an active face of a detector."""
    return tables.faces(spark, d).filter("active").select("photo_id", "detector_id").distinct()


_NEEDING = f"""{with_views("photos", "faces")}, done AS (SELECT DISTINCT photo_id FROM faces WHERE active AND detector_id = 'F')
    SELECT photo_id, state FROM photos LEFT JOIN done USING (photo_id) WHERE state <> 99 AND (state = 0 OR done.photo_id IS NULL)"""


@query(_NEEDING.replace("SELECT photo_id, state FROM photos LEFT JOIN done USING (photo_id)", "SELECT p.photo_id, state FROM photos p LEFT JOIN done ON p.photo_id = done.photo_id"))
def photos_needing_detection(spark, d):
    return lookups.needing_detection(tables.photos(spark, d), _detections(spark, d), "F").select("photo_id", "state")


@query(f"""{with_views("photos", "faces")}, done AS (SELECT DISTINCT photo_id FROM faces WHERE active AND detector_id = 'F')
    SELECT count(*) AS n FROM photos p LEFT JOIN done ON p.photo_id = done.photo_id WHERE state <> 99 AND (state = 0 OR done.photo_id IS NULL)""")
def count_photos_needing_detection(spark, d):
    return lookups.needing_detection(tables.photos(spark, d), _detections(spark, d), "F").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def photos_needing_signature(spark, d):
    return lookups.missing(tables.raw(spark, d, "documents").select("doc_id"), tables.raw(spark, d, "labels"), "doc_id")


@query("SELECT event_id AS face_id FROM events WHERE event_type <> 'purchase' AND event_id NOT IN (SELECT vec_id FROM embeddings)")
def faces_missing_embedding(spark, d):
    active = tables.raw(spark, d, "events").filter("event_type <> 'purchase'").select(F.col("event_id").alias("face_id"))
    return lookups.missing(active, tables.vectors(spark, d), "face_id")


@query(f"""{with_views("vectors")} SELECT face_id, person_id FROM vectors JOIN events ON face_id = event_id WHERE user_id % 2 = 0""")
def active_embeddings(spark, d):
    faces = tables.raw(spark, d, "events").select(F.col("event_id").alias("face_id"), F.lit("d").alias("detector_id"), (F.col("user_id") % 2 == 0).alias("active"))
    return lookups.active_vectors(tables.vectors(spark, d).select("face_id", "person_id"), faces, "d")


@query("SELECT p_partkey AS cluster_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def empty_clusters(spark, d):
    clusters = tables.raw(spark, d, "part").select(F.col("p_partkey").alias("cluster_id"))
    return maintenance.remove_empty_clusters(clusters, tables.faces(spark, d).filter("bbox_w > 45"))


@query(f"""{with_views("vectors")} SELECT face_id, label FROM vectors WHERE face_id NOT IN (SELECT event_id FROM events WHERE event_type = 'click')""")
def ignored_filter(spark, d):
    ignored = tables.raw(spark, d, "events").filter("event_type = 'click'").select(F.col("event_id").alias("face_id"))
    return lookups.missing(tables.vectors(spark, d).select("face_id", "label"), ignored, "face_id")


def _snapshot(spark, d):
    """Files: the photos' own, some grown and some later, and new ones; a few photos have none."""
    p = tables.photos(spark, d)
    size = F.when(F.col("photo_id") % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    time = F.when(F.col("photo_id") % 11 == 0, F.col("taken_utc") + F.expr("interval 1 day")).otherwise(F.col("taken_utc"))
    path = F.when(F.col("photo_id") % 5 == 0, F.concat(F.lit("/new"), F.col("path"))).otherwise(F.upper("path"))
    return p.filter("photo_id % 13 <> 0").select(path.alias("path"), size.alias("length"), time.alias("modified"))


_CHANGES = f"""{with_views("photos")}, snapshot AS (SELECT CASE WHEN photo_id % 5 = 0 THEN '/new' || path ELSE upper(path) END AS path,
        CASE WHEN photo_id % 7 = 0 THEN file_size + 1 ELSE file_size END AS length,
        CASE WHEN photo_id % 11 = 0 THEN taken_utc + INTERVAL 1 DAY ELSE taken_utc END AS modified FROM photos WHERE photo_id % 13 <> 0),
    compared AS (SELECT s.path, p.photo_id, s.length, CASE WHEN p.photo_id IS NULL THEN 'new'
        WHEN s.length <> p.file_size OR s.modified <> p.taken_utc THEN 'changed' ELSE 'unchanged' END AS outcome
        FROM snapshot s LEFT JOIN photos p ON lower(s.path) = lower(p.path))"""


def _compared(spark, d):
    index = tables.photos(spark, d).withColumnRenamed("taken_utc", "mtime_utc")
    return lookups.change_detection(_snapshot(spark, d), index)


@query(f"{_CHANGES} SELECT * FROM compared")
def scan_change_detection(spark, d):
    return _compared(spark, d).select("path", "photo_id", "length", "outcome")


@query(f"{_CHANGES} SELECT outcome, count(*) AS n FROM compared GROUP BY outcome")
def scan_counters(spark, d):
    return incremental.outcome_counts(_compared(spark, d))


@query(f"""{with_views("faces")} SELECT photo_id, detector_id, min(CAST(assignment AS VARCHAR)) AS detector_version, count(*) AS face_count FROM faces GROUP BY photo_id, detector_id""")
def detections_backfill(spark, d):
    return maintenance.detections_backfill(tables.faces(spark, d).withColumn("detector_version", F.col("assignment").cast("string")))


@query(f"""{with_views("photos", "faces", "persons", "vectors")}
    SELECT 'photos' AS table_name, count(*) AS rows FROM photos UNION ALL SELECT 'faces', count(*) FROM faces
    UNION ALL SELECT 'persons', count(*) FROM persons UNION ALL SELECT 'face_embeddings', count(*) FROM vectors""")
def store_summary(spark, d):
    store = {"photos": tables.photos(spark, d), "faces": tables.faces(spark, d), "persons": tables.persons(spark, d), "face_embeddings": tables.vectors(spark, d)}
    return maintenance.describe(store, list(store))


@query(f"""{with_views("faces")} SELECT detector_id, count(*) AS faces, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS active_faces FROM faces GROUP BY detector_id""")
def face_counts(spark, d):
    return tables.faces(spark, d).groupBy("detector_id").agg(F.count("*").alias("faces"), F.sum(F.col("active").cast("long")).alias("active_faces"))


@query(f"""{with_views("faces", "persons", "appear")}, counts AS (SELECT person_id, count(*) AS faces FROM faces WHERE active GROUP BY person_id),
    photos_of AS (SELECT person_id, count(*) AS photos FROM appear GROUP BY person_id)
    SELECT p.person_id, display_name, coalesce(faces, 0) AS faces, coalesce(photos, 0) AS photos
    FROM persons p LEFT JOIN counts c ON p.person_id = c.person_id LEFT JOIN photos_of o ON p.person_id = o.person_id""")
def people_overview(spark, d):
    return people.overview(tables.persons(spark, d), tables.faces(spark, d))


def _clusters(spark, d):
    """Parts stand for clusters: their size is the number of faces; a fifth of them is named."""
    sizes = tables.faces(spark, d).filter("active").groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.withColumn("person_id", F.when(F.col("cluster_id") % 5 == 0, F.col("cluster_id") % 100))


_CLUSTERS = f"""{with_views("faces", "persons")}, clusters AS (SELECT cluster_id, count(*) AS size,
    CASE WHEN cluster_id % 5 = 0 THEN cluster_id % 100 END AS person_id FROM faces WHERE active GROUP BY cluster_id)"""


@query(f"""{_CLUSTERS} SELECT CAST(sum(CASE WHEN person_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unnamed,
    CAST(sum(CASE WHEN person_id IS NULL AND size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single,
    CAST(greatest(0, sum(CASE WHEN person_id IS NULL AND size = 1 THEN 1 ELSE 0 END) - 60) AS BIGINT) AS hidden,
    CAST(sum(CASE WHEN person_id IS NULL THEN size ELSE 0 END) AS BIGINT) AS unnamed_faces FROM clusters""")
def people_header(spark, d):
    t = people.header_totals(_clusters(spark, d))
    return t.select(*[F.col(c).cast("long").alias(c) for c in t.columns])


@query(f"""{_CLUSTERS} SELECT cluster_id, size FROM clusters ORDER BY size DESC, cluster_id""")
def clusters_by_size(spark, d):
    return _clusters(spark, d).select("cluster_id", "size").orderBy(F.desc("size"), "cluster_id")


@query(f"""{_CLUSTERS}, taken AS (SELECT 'Person ' || s_suppkey AS display_name, s_suppkey AS t FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey > 0),
    places AS (SELECT cluster_id, row_number() OVER (ORDER BY size DESC, cluster_id) AS i FROM clusters WHERE person_id IS NULL),
    free AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM (SELECT unnest(range(1, 1 + (SELECT count(*) FROM places) + (SELECT count(*) FROM taken))) AS n) WHERE n NOT IN (SELECT t FROM taken))
    SELECT cluster_id, 'Person ' || n AS display_name FROM places JOIN free USING (i)""")
def auto_name_groups(spark, d):
    taken = tables.persons(spark, d).filter("person_id % 3 = 0 and person_id > 0").select(F.concat(F.lit("Person "), F.col("person_id").cast("string")).alias("display_name"))
    return people.auto_names(_clusters(spark, d).filter("person_id is null"), taken)


@query(f"""{with_views("persons")} SELECT person_id, display_name, row_number() OVER (ORDER BY CAST(regexp_extract(display_name, '\\d+') AS BIGINT), length(display_name), display_name) AS position FROM persons""")
def natural_sort(spark, d):
    placed, _ = numbered(tables.persons(spark, d), T.natural_key("display_name"))
    return placed.select("person_id", "display_name", (F.col("row_no") + 1).alias("position"))


@query(f"""{with_views("faces", "persons", "appear")}, counted AS (SELECT p.person_id, display_name, count(photo_id) AS photos FROM persons p LEFT JOIN appear a ON p.person_id = a.person_id GROUP BY p.person_id, display_name)
    SELECT person_id, row_number() OVER (ORDER BY photos DESC, display_name) AS most, row_number() OVER (ORDER BY photos, display_name) AS fewest,
    row_number() OVER (ORDER BY display_name) AS az, row_number() OVER (ORDER BY display_name DESC) AS za FROM counted""")
def sort_modes(spark, d):
    p = people.overview(tables.persons(spark, d), tables.faces(spark, d))
    out = p.select("person_id")
    for mode in ("most", "fewest", "az", "za"):
        placed, _ = numbered(p, people.sort_people(p, mode))
        out = out.join(placed.select("person_id", (F.col("row_no") + 1).alias(mode)), "person_id")
    return out


@query(f"""{with_views("photos")} SELECT photo_id, row_number() OVER w AS position, lag(photo_id) OVER w AS previous_id, lead(photo_id) OVER w AS next_id, count(*) OVER () AS total
    FROM photos WHERE camera = '1-URGENT' WINDOW w AS (ORDER BY taken_utc DESC, photo_id)""")
def photo_positions(spark, d):
    p = people.neighbours_in_list(tables.photos(spark, d).filter("camera = '1-URGENT'"), F.desc("taken_utc"), "photo_id")
    return p.select("photo_id", F.col("position").cast("long").alias("position"), "previous_id", "next_id", "total")


@query("""SELECT doc_id AS id, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM documents WINDOW w AS (PARTITION BY md5(coalesce(text, ''))) QUALIFY count(*) OVER w > 1""")
def exact_duplicates(spark, d):
    return duplicates.exact_copies(tables.raw(spark, d, "documents"), "doc_id", "text")


@query("""WITH gaps AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events),
    sessions AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps)
    SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS n FROM sessions GROUP BY user_id, s""")
def burst_sessions(spark, d):
    s = incremental.bursts(tables.raw(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "30 minutes")
    return s.select("user_id", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"), "n")


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\\.[^.]+)$', 1)) AS ext, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages""")
def path_parts(spark, d):
    return tables.raw(spark, d, "pages").select("page_id", T.file_name("url").alias("name"), T.extension("url").alias("ext"), T.parent("url").alias("folder"))


@query(f"""{with_views("photos")} SELECT photo_id, CASE WHEN file_size >= 1048576 THEN printf('%.1f MB', file_size / 1048576.0) WHEN file_size >= 1024 THEN printf('%.0f KB', file_size / 1024.0) ELSE file_size || ' B' END AS size FROM photos""")
def byte_sizes(spark, d):
    return tables.photos(spark, d).select("photo_id", T.byte_size_tile("file_size").alias("size"))


@query("""SELECT DISTINCT p_type, replace(trim(p_type), ' ', '_') AS folder FROM part""")
def folder_names(spark, d):
    spaced = tables.raw(spark, d, "part").select("p_type", F.translate("p_type", " ", ":").alias("t")).distinct()
    return spaced.select("p_type", T.folder_name("t").alias("folder"))


@query(f"""{with_views("faces")} SELECT photo_id, person_id, CASE WHEN det_score < 0.6 THEN 'score' WHEN bbox_w < 40 THEN 'side' END AS reason, det_score >= 0.6 AND bbox_w >= 40 AS acceptable, count(*) AS n
    FROM faces GROUP BY ALL""")
def quality_gate(spark, d):
    from kinlight.functions import geometry as G

    f = tables.faces(spark, d)
    none = F.lit(None).cast("double")
    reason = F.regexp_extract(G.rejection(F.col("det_score"), F.col("bbox_w"), F.col("bbox_w"), none), r"^(\w+)", 1)
    out = f.select("photo_id", "person_id", reason.alias("reason"), G.acceptable(F.col("det_score"), F.col("bbox_w"), F.col("bbox_w"), none).alias("acceptable"))
    return out.groupBy("photo_id", "person_id", "reason", "acceptable").agg(F.count("*").alias("n"))


@query(f"""{with_views("faces")} SELECT photo_id, detector_id, CASE WHEN detector_id = 'O' THEN true ELSE false END AS active, count(*) AS n FROM faces GROUP BY ALL""")
def active_detector(spark, d):
    f = maintenance.set_active_detector(tables.faces(spark, d), "O")
    return f.groupBy("photo_id", "detector_id", "active").agg(F.count("*").alias("n"))
