"""Point, range and queue lookups over the library's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.functions.text import contains_text, file_name, fold_case
from kinlight.operators.text_index import TextIndex
from kinlight.plans.lineage import broadcast_if_small


def by_id(table: DataFrame, value: int, key: str = "id") -> DataFrame:
    return table.filter(F.col(key) == value)


def by_text(table: DataFrame, column: str, value: str) -> DataFrame:
    """Rows whose text equals ``value``, ignoring ASCII case."""
    return table.filter(fold_case(column) == fold_case(F.lit(value)))


def search_path(photos: DataFrame, fragment: str, limit: int | None = None, scope: str = "path", index: TextIndex | None = None) -> DataFrame:
    """Photos whose path (or, with ``scope="name"``, file name) holds a literal fragment, by path. An ``index`` of
    the paths by photo_id spares the scan of those that can't."""
    within = F.col("path") if scope == "path" else file_name("path")
    fragment = fragment.strip() if scope == "name" else fragment
    rows = photos if index is None else index.narrowed(photos, "photo_id", fragment)
    found = rows.filter(contains_text(within, fragment)).orderBy("path")
    return found if limit is None else found.limit(limit)


def by_state(photos: DataFrame, state: int, limit: int) -> DataFrame:
    return photos.filter(F.col("state") == state).orderBy("photo_id").limit(limit)


def of_person(faces: DataFrame, person_id: int, detector: str) -> DataFrame:
    """A person's active faces under one detector."""
    return faces.filter((F.col("person_id") == person_id) & (F.col("detector_id") == detector) & F.col("active"))


def of_photo(faces: DataFrame, photo_id: int, detector: str) -> DataFrame:
    """A photo's faces under one detector, active or not."""
    return faces.filter((F.col("photo_id") == photo_id) & (F.col("detector_id") == detector))


def of_cluster(faces: DataFrame, cluster_id: int) -> DataFrame:
    """A cluster's faces, active or not."""
    return faces.filter(F.col("cluster_id") == cluster_id)


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among ``ids``; unknown ids are silently absent."""
    return table.join(broadcast_if_small(ids.select(key).distinct()), key, "left_semi")


def user_decided() -> Column:
    """Faces that the user confirmed or rejected, which automatic passes leave alone."""
    return F.col("assignment").isin(1, 2)


def has_changed(size_a: Column, size_b: Column, time_a: Column, time_b: Column) -> Column:
    return ~(size_a.eqNullSafe(size_b) & time_a.eqNullSafe(time_b))


def can_be_undone(mode: Column, status: Column) -> Column:
    """Moves that completed or failed."""
    return (mode == 1) & status.isin(1, 2)


def has_centroid(column: str = "centroid") -> Column:
    return F.coalesce(F.size(column), F.lit(0)) > 0


def needing_detection(photos: DataFrame, detections: DataFrame, detector: str) -> DataFrame:
    """Photos to detect: not failed, and new or without a detection record under this detector."""
    done = detections.filter(F.col("detector_id") == detector).select("photo_id", F.lit(True).alias("_done"))
    joined = photos.filter("state <> 99").join(done, "photo_id", "left")
    return joined.filter((F.col("state") == 0) | F.col("_done").isNull()).drop("_done")


def missing(table: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows without a derived row yet: faces without a vector, photos without a signature."""
    return table.join(done.select(key), key, "left_anti")


def active_vectors(vectors: DataFrame, faces: DataFrame, detector: str) -> DataFrame:
    """Vectors of the active faces of one detector."""
    wanted = faces.filter((F.col("detector_id") == detector) & F.col("active")).select("face_id")
    return vectors.join(wanted, "face_id")


def change_detection(snapshot: DataFrame, index: DataFrame) -> DataFrame:
    """Compare files (path, length, modified) with the index (photo_id, path, file_size, mtime_utc), paths
    ignoring case: each file with its photo, if known, and ``outcome`` new, changed or unchanged. Photos whose
    files are gone aren't looked for."""
    known = index.select(fold_case("path").alias("_path"), "photo_id", "file_size", "mtime_utc")
    joined = snapshot.withColumn("_path", fold_case("path")).join(known, "_path", "left")
    changed = has_changed(F.col("length"), F.col("file_size"), F.col("modified"), F.col("mtime_utc"))
    outcome = F.when(F.col("photo_id").isNull(), "new").when(changed, "changed").otherwise("unchanged")
    return joined.select("path", "photo_id", "length", "modified", outcome.alias("outcome"))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The latest runs, newest first."""
    return runs.orderBy(F.desc("started_utc"), F.desc("id")).limit(n)


def with_default(left: DataFrame, values: DataFrame, key: str, column: str, default: float = 0.0) -> DataFrame:
    """Add a value by key, or a default where it is missing."""
    return left.join(values.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))
