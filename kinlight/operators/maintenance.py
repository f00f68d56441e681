"""Keeping the store whole: summaries, cascades, keyed updates and deletes, reset, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.plans.lineage import dealt, tasks_for
from kinlight.sources import schema

#: What a summary counts.
SUMMARY = ["photos", "faces", "face_embeddings", "persons", "clusters", "export_runs"]


def empty_store(spark: SparkSession) -> dict[str, DataFrame]:
    """All tables of the newest version, without rows."""
    return {name: spark.createDataFrame([], fields) for name, fields in schema.TABLES.items()}


def describe(store: dict[str, DataFrame], names: list[str] | None = None) -> DataFrame:
    """Rows of each table: (table_name, rows)."""
    parts = [store[n].agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n in names or SUMMARY]
    return reduce(DataFrame.unionByName, parts)


def is_empty(store: dict[str, DataFrame]) -> bool:
    return all(store[n].isEmpty() for n in SUMMARY)


def _cascade_tasks(store: dict[str, DataFrame]) -> int:
    """Tasks for the joins of a cascade, by the largest of its tables."""
    met = [{child, parent} for child, _, parent in schema.CASCADES if child in store and parent in store]
    return tasks_for([store[n] for n in sorted(set().union(*met))])


def cascade(store: dict[str, DataFrame], tasks: int | None = None) -> dict[str, DataFrame]:
    """Drop rows whose parent is gone, parents before children, and null references to what is gone.

    Parents' keys are dealt to ``tasks`` tasks, and children follow; without ``tasks``, the tables are counted. It is
    the right side of these joins that is dealt, as Spark moves such joins below a repartition of the left one.
    References that become null may be hot, so those joins are left to Spark.
    """
    out, tasks = dict(store), _cascade_tasks(store) if tasks is None else tasks
    for child, column, parent in schema.CASCADES:
        if child in out and parent in out:
            known = dealt(out[parent].select(F.col("id").alias(column)), column, tasks)
            out[child] = out[child].join(known, column, "left_semi").select(*store[child].columns)
    for child, column, parent in schema.SET_NULL:
        if child in out and parent in out:
            known = out[parent].select(F.col("id").alias(column), F.lit(True).alias("_known"))
            joined = out[child].join(known, column, "left")
            out[child] = joined.withColumn(column, F.when(F.col("_known"), F.col(column))).select(*store[child].columns)
    return out


def delete_photos(store: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete photos with all that hangs on them."""
    tasks = _cascade_tasks(store)
    left = store["photos"].join(dealt(ids.select("id"), "id", tasks), "id", "left_anti")
    return cascade(store | {"photos": left}, tasks)


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete rows by the columns of ``keys``."""
    return table.join(keys.distinct(), keys.columns, "left_anti").select(*table.columns)


def update_keys(table: DataFrame, delta: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Take columns from ``delta`` where it has the key, nulls included."""
    columns = columns or [c for c in delta.columns if c != key]
    renamed = delta.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = table.join(renamed, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*table.columns)


def set_active_detector(faces: DataFrame, detector: str) -> DataFrame:
    """Faces of one detector become active, all others inactive."""
    return faces.withColumn("active", F.when(F.col("detector_id") == detector, True).otherwise(False))


def detections_backfill(faces: DataFrame) -> DataFrame:
    """Detection records from the faces there are: one for each photo and detector."""
    return faces.groupBy("photo_id", "detector_id").agg(F.min("detector_version").alias("detector_version"), F.count("*").alias("face_count"))


def remove_empty_clusters(clusters: DataFrame, faces: DataFrame) -> DataFrame:
    """Clusters that still have a face."""
    return clusters.join(faces.select("cluster_id").filter("cluster_id is not null"), "cluster_id", "left_semi")


def reset(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All tables without their rows."""
    return {name: table.limit(0) for name, table in store.items()}


def version_of(versions: DataFrame) -> DataFrame:
    """The newest version applied, 0 if none."""
    return versions.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def migrate(store: dict[str, DataFrame], versions: DataFrame) -> tuple[dict[str, DataFrame], list[int]]:
    """Apply the versions that are missing, in order; the second adds detection records for existing faces."""
    spark, now = versions.sparkSession, version_of(versions).first().version
    out, applied = dict(store), []
    for version, names in schema.MIGRATIONS.items():
        if version <= now:
            continue
        for name in names:
            out.setdefault(name, spark.createDataFrame([], schema.TABLES[name]))
        if version == 2 and "faces" in store:
            records = detections_backfill(out["faces"]).select("photo_id", "detector_id", "detector_version", F.col("face_count").cast("int"), F.lit("1970-01-01").cast("timestamp").alias("detected_utc"))
            out["photo_detections"] = records
        applied.append(version)
    return out, applied
