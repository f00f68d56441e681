"""Sets of alike pictures, kept up to date by batches of new signatures.

A folder holds the chunks of all signatures seen, a row for each chunk, partitioned by a hash of the chunk, and the sets
so far. A batch is compared with itself, and its chunks are joined with those stored: only partitions that one of its
chunks falls in are read, and so no signature that shares none. New links join old sets: components are found over the
sets' names and the batch alone, and members of sets that grew together get the new name. Nothing is compared twice.

Batches are written in turn: chunks first, then the sets, which make the batch count. A batch that was stopped in between
is written again whole. Signatures that changed need a fresh folder, as links aren't taken back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.functions.hashing import ALIKE_BITS, ALIKE_SECONDS, hamming, within
from kinlight.operators.duplicates import chunk_keys, hash_pairs, timed_hash_pairs
from kinlight.operators.graph import connected_components
from kinlight.plans.lineage import cut, join_spread

#: Partitions of the stored chunks.
PARTS = 256
CHUNKS = "key long, id long, gradient long, brightness long, at long, part int"
SETS = "member long, set_id long"


class StandingDuplicates:
    """Sets of pictures at most ``bits`` apart and taken within ``seconds`` (None: whenever), under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, bits: int = ALIKE_BITS, seconds: float | None = ALIKE_SECONDS) -> None:
        self.spark, self.folder, self.bits, self.seconds = spark, folder.rstrip("/"), bits, seconds
        hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> int:
        """How many batches count."""
        n = 0
        while self._files.exists(self._path(f"{self.folder}/sets/{n + 1}/_SUCCESS")):
            n += 1
        return n

    def sets(self) -> DataFrame:
        """(member, set_id) of all sets of two or more, named by their smallest member."""
        n = self.batches()
        return self.spark.read.schema(SETS).parquet(f"{self.folder}/sets/{n}") if n else self.spark.createDataFrame([], SETS)

    def stored(self, keys: DataFrame) -> DataFrame:
        """Stored chunks in the partitions that ``keys(part)`` name; there are ``PARTS`` at most."""
        n = self.batches()
        if not n:
            return self.spark.createDataFrame([], CHUNKS)
        parts = sorted(r.part for r in keys.select("part").distinct().collect())
        rows = self.spark.read.schema(CHUNKS).option("basePath", f"{self.folder}/chunks").parquet(*[f"{self.folder}/chunks/batch={i}" for i in range(1, n + 1)])
        return rows.filter(F.col("part").isin(parts))

    def _links(self, batch: DataFrame) -> DataFrame:
        """Links (a, b) of the batch's pictures with each other and with stored ones."""
        own = hash_pairs(batch, self.bits, "id") if self.seconds is None else timed_hash_pairs(batch.withColumn("taken", F.timestamp_micros("at")), self.bits, self.seconds, "id", "taken")
        keys = cut(batch.select(F.explode(chunk_keys(self.bits, True)).alias("key"), *[F.col(c).alias(f"new_{c}") for c in ("id", "gradient", "brightness", "at")]).withColumn("part", _part()))
        met = keys.join(self.stored(keys).drop("part"), "key").filter("id <> new_id")
        near = met.filter(hamming(F.col("gradient"), F.col("brightness"), F.col("new_gradient"), F.col("new_brightness")) <= self.bits)
        timed = near.filter(within(F.timestamp_micros("at"), F.timestamp_micros("new_at"), self.seconds))
        across = timed.select(F.least("id", "new_id").alias("a"), F.greatest("id", "new_id").alias("b"))
        return own.select("a", "b").unionByName(across).distinct()

    def add(self, signatures: DataFrame) -> DataFrame:
        """Add ``signatures(photo_id, gradient, brightness, taken_utc)`` and return all sets. Rows without an id or a
        hash are left out; of repeated ids one counts. An empty batch changes nothing."""
        at = F.unix_micros(F.col("taken_utc").cast("timestamp"))
        batch = cut(signatures.select(F.col("photo_id").cast("long").alias("id"), "gradient", "brightness", at.alias("at")).filter("id is not null and gradient is not null and brightness is not null").dropDuplicates(["id"]))
        n = self.batches() + 1
        old = self.sets()
        links = cut(self._links(batch))
        # old sets stand for their members
        named = links.select("a", "b")
        for end in ("a", "b"):
            named = join_spread(named, old.select(F.col("member").alias(end), F.col("set_id").alias(f"{end}_set")), [end], "b" if end == "a" else "a")
        joined = cut(connected_components(named.select(F.coalesce("a_set", "a").alias("a"), F.coalesce("b_set", "b").alias("b"))))
        grown = joined.select(F.col("node").alias("set_id"), F.col("component").alias("_name"))
        kept = join_spread(old, grown, ["set_id"], "member").select("member", F.coalesce("_name", "set_id").alias("set_id"))
        fresh = joined.join(old.select(F.col("member").alias("node")), "node", "left_anti").select(F.col("node").alias("member"), F.col("component").alias("set_id"))
        chunks = batch.select(F.explode(chunk_keys(self.bits, False)).alias("key"), "id", "gradient", "brightness", "at").withColumn("part", _part())
        chunks.repartition("part").sortWithinPartitions("part", "key").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/chunks/batch={n}")
        kept.unionByName(fresh).select("member", "set_id").write.mode("overwrite").parquet(f"{self.folder}/sets/{n}")
        return self.sets()


def _part() -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int")
