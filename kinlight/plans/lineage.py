"""Cutting lineage, size-checked broadcasts and joins on skewed keys, shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType

#: Rows and bytes up to which a lookup table is broadcast; above either the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20
#: Keys that may count as hot: no more than this many can hold over a share of 1 / HOT_KEYS of the rows each,
#: so a table of them has a bound whatever the input.
HOT_KEYS = 100_000
#: Rows of one key below which it is never hot.
LEAST_HOT = 256
#: About how many rows of the largest table a task of a dealt join takes. Spark's own partitions go by the shuffle's
#: compressed bytes, into which narrow rows fit by the million, and sorts and hash maps take some 300 bytes for each.
TASK_ROWS = 1_250_000


def checkpoint_dir(spark: SparkSession) -> str:
    """Make sure a checkpoint folder is set, and return it.

    The cluster names a shared folder in ``spark.checkpoint.dir``. Only a session whose driver and executors are
    one process (tests, notebooks) may leave it unset, and gets a temporary folder; elsewhere a folder of this
    machine would be out of the executors' reach, so that raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinlight-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and return it without its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data in whatever store it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _bytes_of(value: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 8
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, MapType, StructType)):
            inner = F.aggregate(value, F.lit(0).cast("long"), lambda a, x: a + _bytes_of(x, kind.elementType))
            return F.coalesce(inner, F.lit(0).cast("long")) + 16
        return F.greatest(F.size(value), F.lit(0)).cast("long") * 8 + 16
    if isinstance(kind, StructType):
        total = F.lit(8).cast("long")
        for field in kind.fields:
            total = total + _bytes_of(value[field.name], field.dataType)
        return total
    if isinstance(kind, MapType):
        return _bytes_of(F.map_keys(value), ArrayType(kind.keyType)) + _bytes_of(F.map_values(value), ArrayType(kind.valueType))
    return F.lit(8).cast("long")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``max_rows`` rows and ``max_bytes`` bytes. The count stops at ``max_rows + 1``."""
    size = F.lit(0).cast("long")
    for field in df.schema.fields:
        size = size + _bytes_of(F.col(f"`{field.name}`"), field.dataType)
    n, held = df.limit(max_rows + 1).select(size.alias("size")).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= max_rows and held <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a table that :func:`is_small`. A larger table is returned as it is, so that Spark plans
    a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows, max_bytes) else df


def tasks_for(tables: list[DataFrame]) -> int:
    """In how many tasks none has more than about ``TASK_ROWS`` rows of any of ``tables``, which are counted: 1, or
    one for each core at least."""
    rows = max((t.count() for t in tables), default=0)
    return 1 if rows <= TASK_ROWS else max(-(-rows // TASK_ROWS), tables[0].sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, key: str, tasks: int) -> DataFrame:
    """``df`` dealt by ``key`` to that many tasks, which joins and groups by the key then keep; as it is where one
    is enough."""
    return df.repartition(tasks, key) if tasks > 1 else df


def join_spread(left: DataFrame, table: DataFrame, keys: list[str], salt_by: str, how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) to ``left`` where a few keys may hold most of ``left``'s rows.

    Rows are counted by key, combined map-side. A key with over ``LEAST_HOT`` rows and a share of over
    1 / ``HOT_KEYS`` is hot; there are at most ``HOT_KEYS`` of those, so they are broadcast. A hot key's rows are
    dealt by ``salt_by`` to as many salts as it has such shares, and ``table``'s row for it is copied as often:
    the copies are at most twice ``HOT_KEYS`` in all. The join runs on (key, salt).
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total = counts.agg(F.sum("_rows").alias("_total"))
    salts = F.ceil(F.col("_rows") / F.greatest(F.lit(LEAST_HOT), F.col("_total") / HOT_KEYS))
    hot = counts.crossJoin(F.broadcast(total)).select(*keys, salts.cast("int").alias("_salts")).filter("_salts > 1")
    of = F.coalesce("_salts", F.lit(1))
    salted = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(salt_by), of).cast("int")).drop("_salts")
    spread = table.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), of - 1))).drop("_salts")
    return salted.join(spread, [*keys, "_salt"], how).drop("_salt")
