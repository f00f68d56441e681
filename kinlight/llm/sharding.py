"""Reproducible shuffled shards: a Feistel permutation over global row numbers.

Rows are numbered 0 to N - 1 in the order of their ids. A Feistel network permutes the smallest even
number of bits that holds N; a result of N or more walks on through the network until it falls below N,
which keeps the map a permutation of 0 to N - 1. Shard and slot are the remainder and quotient of the
permuted number: anyone who knows N and the seed computes where a row is, and which row a slot holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.plans.numbering import numbered

ROUNDS = 6
SHARDS = 8
SEED = 20240229


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift) of x plus a round key; uint64 arithmetic wraps."""
    z = x + np.uint64(key)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int], inverse: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return left << shift | right


def permuted(rows: np.ndarray, n: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Where the permutation of 0 to n - 1 takes each of ``rows`` (or, ``inverse``, came from)."""
    x = np.asarray(rows).astype(np.uint64)
    half, keys = _half_bits(n), _keys(seed)
    x = _network(x, half, keys, inverse)
    outside = np.flatnonzero(x >= n)
    while len(outside):
        x[outside] = _network(x[outside], half, keys, inverse)
        outside = outside[x[outside] >= n]
    return x.astype(np.int64)


def place_of(row: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of one row number, computed without the data."""
    p = int(permuted(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that a shard's slot holds."""
    return int(permuted(np.array([slot * shards + shard]), n, seed, inverse=True)[0])


def _placing(n: int, shards: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permuted(batch.column("row_no").to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], [*batch.schema.names, "shard", "slot"])

    return run


def _size(text: str) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each row of ``docs``: doc_id, size, text_crc32, row_no, shard, slot.

    The law is ``rows``: shards hold equal numbers of rows, at most one apart, and slots of a shard run
    from 0 without gaps. Size is the UTF-8 bytes of the text plus 1; null text has size 1 and CRC 0.
    Rows are numbered in the order of id (null first), CRC and size, so the result depends on the rows
    and the seed, not on files or partitions; rows equal in all three are interchangeable. An empty table
    gives an empty result. Texts never leave the map side: three numbers a row are sorted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _size(text_col).alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    placed, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    return placed.mapInArrow(_placing(n, shards, seed), "doc_id long, size long, text_crc32 long, row_no long, shard int, slot long")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Write ``docs`` as parquet, one folder ``shard=n`` a shard, whose files hold ranges of slots in order.

    Every row is written once, null texts and rows without an id too; rows that share an id go by their text as
    well, and those that are equal in both are interchangeable. Columns may have any names: if ``docs`` has a
    column ``shard``, the folders' name gets an underscore. An empty table writes no row.
    """
    same = ["doc_id", "text_crc32", "size"]
    key = {c: common.unused(f"row_{c}", docs) for c in (*same, "nth")}
    place = {c: common.unused(f"at_{c}", docs) for c in (*same, "nth", "shard", "slot")}
    places = assign_shards(docs, shards, seed).withColumn("nth", F.row_number().over(_window(same)))
    places = places.select(*[F.col(c).alias(name) for c, name in place.items()])
    keyed = docs.withColumns({key["doc_id"]: F.col("doc_id").cast("long"), key["text_crc32"]: F.crc32(F.coalesce("text", F.lit("")).cast("binary")), key["size"]: _size("text")})
    keyed = keyed.withColumn(key["nth"], F.row_number().over(_window([key[c] for c in same])))
    on = F.lit(True)
    for c, name in key.items():
        on = on & F.col(name).eqNullSafe(F.col(place[c]))
    joined = keyed.join(places, on).select(*docs.columns, place["shard"], place["slot"])
    ordered = joined.repartitionByRange(place["shard"], place["slot"]).sortWithinPartitions(place["shard"], place["slot"])
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    ordered.drop(place["slot"]).withColumnRenamed(place["shard"], name).write.partitionBy(name).parquet(path)


def _window(columns: list[str]) -> WindowSpec:
    return Window.partitionBy(*columns).orderBy(*columns)
