"""Writing tables: upserts by key, inserts of what is new, replaced partitions, and the export journal.

Upserts are pure: they take the table and the change and return the new table, so that they compose and can be
tested; :func:`publish` then writes to a fresh folder and swaps it in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlight.functions.text import fold_case


def last_of(change: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row of ``change`` for each key: the last by ``order``, or without one by all other columns in turn, so
    that the result depends on the rows alone. Combined map-side; null keys are keys like others."""
    by = [c for c in [*(order or []), *change.columns] if c not in keys]
    last = F.max_by(F.struct(*change.columns), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(by or keys)]))
    return change.groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys]).agg(last.alias("_last")).select("_last.*")


def upsert(base: DataFrame, change: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``change`` replace those of ``base`` with the same key; others are added. Of several changes to a
    key, the last by ``order`` counts (see :func:`last_of`)."""
    last = last_of(change, keys, order)
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_by_path(base: DataFrame, change: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Photos by path, ignoring case: a known path keeps its id and takes all other columns anew. Of several changes
    to a path, the last by ``order`` counts (see :func:`last_of`)."""
    known = base.select(F.col("id").alias("_known_id"), fold_case("path").alias("_path"))
    keyed = last_of(change.withColumn("_path", fold_case("path")), ["_path"], order).join(known, "_path", "left")
    new = keyed.withColumn("id", F.coalesce("_known_id", "id")).drop("_known_id")
    kept = base.withColumn("_path", fold_case("path")).join(new.select("_path").distinct(), "_path", "left_anti")
    return kept.unionByName(new).drop("_path")


def insert_absent(base: DataFrame, change: DataFrame, keys: list[str], fold: list[str] | None = None) -> DataFrame:
    """Rows of ``change`` whose key ``base`` hasn't are added, once each; keys in ``fold`` ignore case."""
    fold = fold or []

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns({f"_key_{k}": fold_case(k) if k in fold else F.col(k) for k in keys})

    names = [f"_key_{k}" for k in keys]
    new = keyed(change).dropDuplicates(names).join(keyed(base).select(*names), names, "left_anti")
    return base.unionByName(new.drop(*names))


def link_faces(links: DataFrame, change: DataFrame) -> DataFrame:
    """Upsert pairs of faces, smaller id first; of several changes to a pair the newest counts."""
    ordered = change.withColumns({"face_a": F.least("face_a", "face_b"), "face_b": F.greatest("face_a", "face_b")}).filter("face_a <> face_b")
    newest = Window.partitionBy("face_a", "face_b").orderBy(F.desc("created_utc"), F.desc("kind"))
    last = ordered.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return upsert(links, last, ["face_a", "face_b"])


def replace_partition(base: DataFrame, new: DataFrame, **partition: str) -> DataFrame:
    """All rows of one partition are replaced by ``new``."""
    here: Column = F.lit(True)
    for column, value in partition.items():
        here = here & F.col(column).eqNullSafe(F.lit(value))
    return base.filter(~here).unionByName(new.filter(here))


def write_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """Overwrite just the partitions that ``new`` holds."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def publish(table: DataFrame, path: str) -> None:
    """Write a table beside ``path``, then swap it in: readers see the old or the new rows, never a part. If
    the write fails, nothing has changed. Between two renames there is no table; a crash just there leaves the old
    rows in ``path.old`` and the new ones in ``path.staged``, from which :func:`recover` goes on."""
    spark: SparkSession = table.sparkSession
    recover(spark, path)  # what an earlier crash left staged isn't written over
    jvm, staged = spark.sparkContext._jvm, f"{path}.staged"
    table.write.mode("overwrite").parquet(staged)
    target, source, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staged, f"{path}.old"))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.delete(old, True)
    if store.exists(target):
        store.rename(target, old)
    store.rename(source, target)
    store.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back a table that a crash of :func:`publish` left without its folder: the new rows if they were written
    whole, else the old ones. Whether there was something to do."""
    jvm = spark.sparkContext._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.old"))
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(target):
        return False
    if store.exists(jvm.org.apache.hadoop.fs.Path(f"{path}.staged/_SUCCESS")):
        return bool(store.rename(staged, target))
    return bool(store.exists(old) and store.rename(old, target))


def journal_add(ops: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned operations are appended before any of them runs."""
    return ops.unionByName(planned)


def journal_update(ops: DataFrame, outcome: DataFrame) -> DataFrame:
    """Take status, bytes and error from ``outcome(id, status, bytes, error)`` where it has the operation."""
    o = outcome.select("id", *[F.col(c).alias(f"_{c}") for c in ("status", "bytes", "error")])
    joined = ops.join(o, "id", "left")
    known = F.col("_status").isNotNull()
    return joined.withColumns({c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("status", "bytes", "error")}).drop("_status", "_bytes", "_error")
