"""People: overview, covers, calibration, and the changes a user makes, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.functions.text import fold_case, natural_key, valid_name
from kinlight.functions.vectors import dot
from kinlight.operators.vectors import unit_mean
from kinlight.plans.lineage import join_spread
from kinlight.plans.numbering import free_numbers, numbered
from kinlight.sources.sinks import upsert

SINGLE_TILES = 60


def person_counts(faces: DataFrame) -> DataFrame:
    """Active faces and distinct photos per person: (person_id, faces, photos)."""
    kept = faces.filter(F.col("active") & F.col("person_id").isNotNull())
    per_photo = kept.groupBy("person_id", "photo_id").agg(F.count("*").alias("n"))
    return per_photo.groupBy("person_id").agg(F.sum("n").alias("faces"), F.count("*").alias("photos"))


def overview(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """All people with their counts, zero where none: (person_id, display_name, faces, photos)."""
    zero = F.lit(0).cast("long")
    return persons.select("person_id", "display_name").join(person_counts(faces), "person_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("faces", "photos")})


def sort_people(people: DataFrame, mode: str) -> list[Column]:
    """Order of a people list: most, fewest, az or za; ties go by natural name."""
    name = natural_key("display_name")
    return {"most": [F.desc("photos"), *name], "fewest": [F.asc("photos"), *name], "az": name, "za": [c.desc() for c in name]}[mode]


def header_totals(clusters: DataFrame, shown: int = SINGLE_TILES) -> DataFrame:
    """Totals of ``clusters(cluster_id, person_id, size)``: unnamed groups, unnamed single ones, those of
    them beyond the tiles shown, and unnamed faces."""
    unnamed = F.col("person_id").isNull()
    single = F.sum(F.when(unnamed & (F.col("size") == 1), 1).otherwise(0))
    return clusters.agg(F.sum(unnamed.cast("long")).alias("unnamed"), single.alias("single"), F.greatest(F.lit(0), single - shown).alias("hidden"), F.sum(F.when(unnamed, F.col("size")).otherwise(0)).alias("unnamed_faces"))


def tiles(clusters: DataFrame, shown: int = SINGLE_TILES) -> DataFrame:
    """Unnamed groups to show, larger ones first: all of two or more, and the first ``shown`` single ones."""
    unnamed = clusters.filter("person_id is null")
    single = unnamed.filter("size = 1").orderBy("cluster_id").limit(shown)
    return unnamed.filter("size > 1").unionByName(single).orderBy(F.desc("size"), "cluster_id")


def dismissed(total: Column, named: Column, unnamed: Column) -> Column:
    return F.greatest(F.lit(0), total - named - unnamed)


def covers(faces: DataFrame, centroids: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Each person's cover face: (person_id, cover_face_id). The current one stays if it is still the
    person's; else the face nearest to the centroid; else, without vectors, the largest by shorter side and
    score. ``faces(face_id, person_id, vector, min_side, score)``; ties go to the smaller id."""
    near = F.when(F.size("vector") > 0, F.round(dot("vector", "centroid"), 9))
    known = centroids.select("person_id", "centroid")
    if current is not None:
        known = known.join(current.select("person_id", F.col("cover_face_id").alias("_now")), "person_id", "full")
    else:
        known = known.withColumn("_now", F.lit(None).cast("long"))
    joined = join_spread(faces, known, ["person_id"], "face_id")
    kept = F.coalesce(F.col("face_id") == F.col("_now"), F.lit(False))
    best = F.max(F.struct(kept.alias("kept"), near.alias("near"), F.col("min_side").alias("side"), F.col("score").alias("score"), (-F.col("face_id")).alias("first")))
    return joined.groupBy("person_id").agg(best.alias("best")).select("person_id", (-F.col("best.first")).alias("cover_face_id"))


def calibrate(persons: DataFrame, faces: DataFrame) -> DataFrame:
    """People with centroid and cover recomputed from their faces; people without vectors have no centroid."""
    centroids = unit_mean(faces.filter("person_id is not null"), "person_id").select("person_id", "centroid")
    cover = covers(faces.filter("person_id is not null"), centroids, persons.select("person_id", "cover_face_id"))
    return persons.drop("centroid", "cover_face_id").join(centroids, "person_id", "left").join(cover, "person_id", "left")


# --- changes -----------------------------------------------------------------------------------------------


def assign(faces: DataFrame, which: Column, person: Column, assignment: Column | int) -> DataFrame:
    """Faces with person and assignment set where ``which`` holds."""
    new = F.lit(assignment) if isinstance(assignment, int) else assignment
    return faces.withColumns({"person_id": F.when(which, person.cast("long")).otherwise(F.col("person_id")), "assignment": F.when(which, new).otherwise(F.col("assignment"))})


def move_faces(faces: DataFrame, which: Column, to_person: int) -> DataFrame:
    """Move chosen faces to another person, as confirmed."""
    return assign(faces, which, F.lit(to_person), 1)


def remove_faces(faces: DataFrame, which: Column) -> DataFrame:
    """Take chosen faces from their person, as rejected."""
    return assign(faces, which, F.lit(None), 2)


def delete_person(persons: DataFrame, faces: DataFrame, clusters: DataFrame | None, person_id: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Remove a person: their faces lose the person and, unless rejected, go back to automatic; their
    clusters lose the name."""
    own = F.col("person_id").eqNullSafe(person_id)
    back = faces.withColumns({"assignment": F.when(own & (F.col("assignment") != 2), 0).otherwise(F.col("assignment")), "person_id": F.when(own, F.lit(None)).otherwise(F.col("person_id"))})
    unnamed = None if clusters is None else clusters.withColumn("person_id", F.when(own, F.lit(None)).otherwise(F.col("person_id")))
    return persons.filter(F.col("person_id") != person_id), back, unnamed


def merge_people(persons: DataFrame, faces: DataFrame, clusters: DataFrame | None, keep: int, sources: list[int]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Merge people into one: their faces go over as confirmed, rejected ones keep their rejection."""
    others = sorted(set(sources) - {keep})
    gone = F.coalesce(F.col("person_id").isin(others), F.lit(False)) if others else F.lit(False)
    moved = faces.withColumns({"assignment": F.when(gone & (F.col("assignment") != 2), 1).otherwise(F.col("assignment")), "person_id": F.when(gone, F.lit(keep).cast("long")).otherwise(F.col("person_id"))})
    renamed = None if clusters is None else clusters.withColumn("person_id", F.when(gone, F.lit(keep).cast("long")).otherwise(F.col("person_id")))
    return persons.filter(~gone), moved, renamed


def rename_person(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    """Rename unless the name is invalid or, ignoring case, somebody else's; then nothing changes."""
    clash = persons.filter((fold_case("display_name") == fold_case(valid_name(F.lit(name)))) & (F.col("person_id") != person_id)).limit(1).select(F.lit(True).alias("_clash"))
    joined = persons.join(F.broadcast(clash), F.lit(True), "left")
    new = valid_name(F.lit(name))
    change = (F.col("person_id") == person_id) & F.col("_clash").isNull() & new.isNotNull()
    return joined.withColumn("display_name", F.when(change, new).otherwise(F.col("display_name"))).drop("_clash")


def name_cluster(persons: DataFrame, faces: DataFrame, cluster: int, name: str, new_id: int) -> tuple[DataFrame, DataFrame, str]:
    """Name a cluster. Faces that the user decided on stay; if none is left to assign, nothing changes and the
    outcome names the sole owner, if there is one. A name in use, ignoring case, means that person."""
    clean = persons.sparkSession.range(1).select(valid_name(F.lit(name)).alias("n")).first().n
    if clean is None:
        return persons, faces, "invalid"
    here = F.col("cluster_id").eqNullSafe(cluster)
    free = here & ~F.coalesce(F.col("assignment").isin(1, 2), F.lit(False))
    if faces.filter(free).isEmpty():
        owners = faces.filter(here & F.col("person_id").isNotNull()).select("person_id").distinct().limit(2).collect()
        return persons, faces, f"owned by {owners[0].person_id}" if len(owners) == 1 else "nothing to assign"
    known = persons.filter(fold_case("display_name") == fold_case(F.lit(clean))).select("person_id").first()
    person = known.person_id if known else new_id
    if not known:
        added = persons.sparkSession.createDataFrame([(person, clean)], "person_id long, display_name string")
        persons = persons.unionByName(added, allowMissingColumns=True)
    return persons, assign(faces, free, F.lit(person), 0), "merged" if known else "named"


def ignore_cluster(faces: DataFrame, ignored: DataFrame, cluster: int) -> tuple[DataFrame, DataFrame]:
    """Put a cluster's faces on the ignored list and take them out of it."""
    here = F.col("cluster_id").eqNullSafe(cluster)
    listed = faces.filter(here).select("face_id")
    return faces.withColumn("cluster_id", F.when(here, F.lit(None)).otherwise(F.col("cluster_id"))), ignored.select("face_id").union(listed).distinct()


def restore_ignored(ignored: DataFrame) -> tuple[DataFrame, int]:
    """The ignored list without its faces, and how many there were; the next grouping sees them again."""
    return ignored.limit(0), ignored.select("face_id").distinct().count()


def save_person(persons: DataFrame, person: DataFrame) -> DataFrame:
    """Insert or update people by id; columns that ``person`` lacks are null."""
    return upsert(persons, person.unionByName(persons.limit(0), allowMissingColumns=True).select(*persons.columns), ["person_id"])


def auto_names(clusters: DataFrame, taken: DataFrame, prefix: str = "Person ") -> DataFrame:
    """Placeholder names for unnamed ``clusters(cluster_id, size)`` in order of size, numbered from 1 and
    skipping numbers whose name ``taken(display_name)`` has: (cluster_id, display_name). The i-th cluster gets the
    i-th free number."""
    return numbered_names(clusters, taken, prefix).select("cluster_id", "display_name")


def numbered_names(clusters: DataFrame, taken: DataFrame, prefix: str) -> DataFrame:
    """As :func:`auto_names`, with ``nth``, the cluster's place from 1 in order of size."""
    group = F.lit("")
    ranked, _ = numbered(clusters.select("cluster_id", "size"), [F.desc("size"), F.asc("cluster_id")])
    places = ranked.select(group.alias("_all"), "cluster_id", (F.col("row_no") + 1).alias("nth"))
    number = F.expr(f"try_cast(substring(display_name, {len(prefix) + 1}) as bigint)")
    written = F.concat(F.lit(prefix), number.cast("string"))  # "Person 007" doesn't take 7
    used = taken.filter(fold_case("display_name") == fold_case(written)).select(group.alias("_all"), number.alias("number"))
    return free_numbers(places, used, "_all").select("cluster_id", "nth", F.concat(F.lit(prefix), F.col("number").cast("string")).alias("display_name"))


def repair_clusters(clusters: DataFrame, members: DataFrame, medoids: DataFrame) -> DataFrame:
    """What repair does to ``clusters(cluster_id, size, medoid_face_id)`` given ``members(cluster_id)`` and
    fresh ``medoids(cluster_id, medoid)``: each with its true size and medoid and an ``action``: removed (no
    members left), fixed or kept. Repairing twice changes nothing."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("true_size"))
    joined = clusters.join(sizes, "cluster_id", "left").join(medoids, "cluster_id", "left")
    same = F.col("size").eqNullSafe(F.col("true_size")) & F.col("medoid_face_id").eqNullSafe(F.col("medoid"))
    action = F.when(F.col("true_size").isNull(), "removed").when(same, "kept").otherwise("fixed")
    return joined.select("cluster_id", F.coalesce("true_size", F.lit(0)).alias("size"), F.col("medoid").alias("medoid_face_id"), action.alias("action"))


def others(persons: DataFrame, person_id: int) -> DataFrame:
    """Everybody but one person."""
    return persons.filter(F.col("person_id") != person_id)


def photos_of(faces: DataFrame, photos: DataFrame, person_id: int, detector: str) -> DataFrame:
    """A person's photos, one row each, newest first."""
    seen = faces.filter((F.col("person_id") == person_id) & F.col("active") & (F.col("detector_id") == detector)).select("photo_id").distinct()
    return photos.join(seen, "photo_id", "left_semi").orderBy(F.desc("taken_utc"), "photo_id")


def neighbours_in_list(photos: DataFrame, *order: Column | str) -> DataFrame:
    """Position, count, previous and next photo of each photo in an order. Neighbours are joined by position,
    so no task needs all photos."""
    placed, total = numbered(photos, list(order))
    placed = placed.withColumn("position", F.col("row_no") + 1).drop("row_no")
    before = placed.select((F.col("position") + 1).alias("position"), F.col("photo_id").alias("previous_id"))
    after = placed.select((F.col("position") - 1).alias("position"), F.col("photo_id").alias("next_id"))
    return placed.join(before, "position", "left").join(after, "position", "left").withColumn("total", F.lit(total).cast("long"))
