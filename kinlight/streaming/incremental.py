"""Resumable micro-batches: new files and rows are processed once, markers remember what is done, and a
batch that runs again replaces its rows instead of adding to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.listener import StreamingQueryListener

from kinlight.functions.text import supported
from kinlight.plans.lineage import cut

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, root: str, per_batch: int = 200) -> DataFrame:
    """A stream of supported files that appear below a folder. A file that changes under a known path is not
    delivered again; :func:`kinlight.operators.lookups.change_detection` finds those."""
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch)
    return reader.load(root).filter(supported("path"))


def new_rows(spark: SparkSession, path: str, fields, per_batch: int = 1) -> DataFrame:
    """A stream of parquet files added to a folder, ``per_batch`` files at a time."""
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", per_batch).parquet(path)


def process_once(stream: DataFrame, key: list[str], derive: Callable[[DataFrame], DataFrame], target: str, markers: str, checkpoint: str) -> DataStreamWriter:
    """A writer that derives rows for what isn't marked yet. Results and markers go to a folder a batch each,
    which a repeated batch overwrites: after a failure nothing is doubled. Rows that derive nothing are marked,
    too, so that they don't come back."""

    def handle(batch: DataFrame, number: int) -> None:
        todo = batch.dropDuplicates(key)
        spark = batch.sparkSession
        hadoop, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(markers)
        if path.getFileSystem(hadoop).exists(path):
            done = spark.read.option("basePath", markers).parquet(markers).filter(F.col("batch") != number)
            todo = todo.join(done.select(*key), key, "left_anti")
        todo = cut(todo)
        derive(todo).write.mode("overwrite").parquet(f"{target}/batch={number}")
        todo.select(*key).write.mode("overwrite").parquet(f"{markers}/batch={number}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)


def rederive(table: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Derived rows of the keys in ``fresh`` are replaced, all others stay."""
    return table.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def stale_signatures(photos: DataFrame, signatures: DataFrame) -> DataFrame:
    """Photos whose signature is missing or older than the photo."""
    made = signatures.select("photo_id", "computed_utc")
    joined = photos.filter("error is null").join(made, "photo_id", "left")
    return joined.filter(F.col("computed_utc").isNull() | (F.col("mtime_utc") > F.col("computed_utc"))).drop("computed_utc")


def bursts(events: DataFrame, gap: str = "2 minutes", late: str | None = None) -> DataFrame:
    """Sessions per user: runs of events no more than a gap apart. On a stream, ``late`` is how long late events
    are waited for. (An extension: sessions by time only.)"""
    timed = events if late is None else events.withWatermark("ts", late)
    found = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.select("user_id", "first_ts", "last_ts", "n")


def on_progress(spark: SparkSession, tell: Callable[[str, int], None]) -> StreamingQueryListener:
    """Call ``tell(query name, rows)`` after every batch, so that screens know when to refresh."""

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event) -> None:
            pass

        def onQueryProgress(self, event) -> None:
            tell(event.progress.name, event.progress.numInputRows)

        def onQueryIdle(self, event) -> None:
            pass

        def onQueryTerminated(self, event) -> None:
            pass

    listener = Listener()
    spark.streams.addListener(listener)
    return listener


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """Counters of a run: rows by outcome."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
