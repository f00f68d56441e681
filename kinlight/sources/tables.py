"""Domain tables over the parquet tables at hand.

Orders stand for photos, lines for the faces in them, suppliers for people, and embeddings for face vectors
with a person from their label. The views prune to the columns a query selects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.functions.hashing import brightness_hash, ring_gradient_hash


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, path, file_size, taken_utc, camera, state."""
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("photo_id"),
        F.concat(F.lit("/lib/"), F.col("o_custkey").cast("string"), F.lit("/IMG_"), F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("path"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("file_size"),
        F.col("o_orderdate").alias("taken_utc"),
        F.col("o_orderpriority").alias("camera"),
        F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "F", 2).otherwise(99).alias("state"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, person_id, detector_id, active, assignment, bbox_w, det_score. A line isn't unique by its
    numbers, so these rows carry no face id."""
    li = raw(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("photo_id"),
        F.col("l_suppkey").alias("person_id"),
        F.col("l_linestatus").alias("detector_id"),
        (F.col("l_returnflag") != "R").alias("active"),
        F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 2).otherwise(0).alias("assignment"),
        F.col("l_quantity").alias("bbox_w"),
        (1 - F.col("l_discount")).alias("det_score"),
        F.col("l_partkey").alias("cluster_id"),
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """person_id, display_name."""
    return raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("display_name"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """face_id, vector, label, and a finer person: ten of them to a label."""
    e = raw(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("face_id"), F.col("embedding").alias("vector"), "label", (F.col("label") * 10 + F.col("vec_id") % 10).alias("person_id"))


def signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo_id, gradient, brightness and sharpness of an 8 x 8 grid view of each embedding, and a capture
    time: that of the event with the same number."""
    e = raw(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo_id"), "embedding")
    hashed = e.select("photo_id", ring_gradient_hash("embedding").alias("gradient"), brightness_hash("embedding").alias("brightness"), laplacian_variance("embedding").alias("sharpness"))
    taken = raw(spark, sf_dir, "events").select(F.col("event_id").alias("photo_id"), F.col("ts").alias("taken_utc"))
    return hashed.join(taken, "photo_id", "left")


def laplacian_variance(grid: Column | str, side: int = 8) -> Column:
    """The variance of a square grid's 4-neighbour Laplacian over its inner cells."""
    grid = F.col(grid) if isinstance(grid, str) else grid

    def at(y: int, x: int) -> Column:
        return F.get(grid, F.lit(y * side + x)).cast("double")

    values = F.array(*[4 * at(y, x) - at(y - 1, x) - at(y + 1, x) - at(y, x - 1) - at(y, x + 1) for y in range(1, side - 1) for x in range(1, side - 1)])
    n = (side - 2) ** 2
    total = F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + v)
    squares = F.aggregate(values, F.lit(0.0).cast("double"), lambda a, v: a + v * v)
    return F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n))
