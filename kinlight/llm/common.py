"""Shared plumbing: reading tables, Arrow text buffers, white space and word boundaries in numpy."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.plans.lineage import broadcast_if_small, cut

#: Bytes of rows handed to Python at once (one row at least).
TEXT_BATCH_BYTES = 8 << 20
#: Bytes of text worked on at once inside a batch; numpy temporaries are a small multiple of it.
SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the parquet tables; the path may be in any store Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def size_in_bytes(setting: str) -> int:
    """Bytes of a Spark size setting, such as 256m or 1gb."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)b?\s*", setting.lower()).groups()
    return int(number) * _UNITS[unit]


def small_text_batches(spark: SparkSession) -> None:
    """Lower the bytes per Arrow batch from Spark's default, as rows here hold whole texts. Spark has no such
    setting for one plan, so the session keeps it; it bounds memory and changes no result."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = size_in_bytes(spark.conf.get(key))
    if now > TEXT_BATCH_BYTES or now <= 0:
        spark.conf.set(key, f"{TEXT_BATCH_BYTES}b")


def unused(base: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    name = f"_{base}"
    while name in taken:
        name += "_"
    return name


Batches = Iterator[pa.RecordBatch]


def trimmed(function: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function that gives its memory back to the system when its partition is done, as Spark keeps
    the worker for other tasks."""

    def run(batches: Batches) -> Batches:
        try:
            yield from function(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Return free memory to the system, Arrow's own pool and, where it can, the C library's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets from 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n, start = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[start : start + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def is_long(offsets: np.ndarray, i: int, j: int) -> bool:
    """Whether documents [i, j) are one that is longer than a slice."""
    return j == i + 1 and offsets[j] - offsets[i] > SLICE_BYTES


def runs_of_documents(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive documents that hold at most ``limit`` bytes, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _first(flag: np.ndarray, data: np.ndarray, at: int, step: int = 1 << 16) -> int:
    """The first place from ``at`` on whose byte is (True) or isn't (False) white, or the end."""
    while at < len(data):
        hit = np.flatnonzero(WHITE[data[at : at + step]] == flag)
        if len(hit):
            return at + int(hit[0])
        at += step
    return len(data)


def pieces_of_words(data: np.ndarray, overlap: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray]]:
    """Cut one text at white space into pieces of about ``limit`` bytes, each with how many words stand before it. A
    piece begins with the last ``overlap`` words of the one before, so a run of ``overlap`` + 1 words is whole in just
    one piece. A text of words longer than that makes longer pieces: each has more than ``overlap`` words, if the text
    has."""
    at = before = 0
    while True:
        size = limit
        while True:
            end = _first(True, data, min(at + size, len(data)))
            last = _first(False, data, end) == len(data)
            piece = data[at : len(data) if last else end]
            if last:
                yield before, piece
                return
            starts, _, _ = word_bounds(piece, np.array([0, len(piece)]))
            if len(starts) > overlap:
                break
            size *= 2
        yield before, piece
        before += len(starts) - overlap
        at = at + int(starts[len(starts) - overlap]) if overlap else _first(False, data, end)


def tiles(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """Cut one text after a word into pieces of about ``limit`` bytes that leave nothing out."""
    at = 0
    while at < len(data):
        end = _first(True, data, min(at + limit, len(data)))
        yield data[at:end]
        at = end


def collapse_white(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace each run of ``[\\x20\\x09-\\x0D]`` inside a document by one space."""
    white = WHITE[data]
    before = np.empty_like(white)
    before[:1] = False
    before[1:] = white[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    keep = ~(white & before)
    out = np.where(white, np.uint8(32), data)[keep]
    kept = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return out, kept[offsets]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the index of its
    first word (n + 1 values)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~WHITE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # document borders end a word, too
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def text_key() -> Column:
    """A hash that tells rows of one id and different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def drop_keys(docs: DataFrame, digest: Column, decided: DataFrame, digest_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, digest) ``decided(doc_id, <digest_col>, kept, n)`` keeps, with all their
    columns; of ``n`` rows that share a kept key, one stays.

    Only the rejected keys are joined to the documents: broadcast where they are few, shuffled otherwise.
    Columns of ``docs`` may have any names beside ``doc_id`` and ``text``.
    """
    mark, key, of = (unused(base, docs) for base in ("digest", "key_id", "key_digest"))
    marked = docs.withColumn(mark, digest)

    def by(keys: DataFrame) -> tuple[DataFrame, Column]:
        named = broadcast_if_small(keys.select(F.col("doc_id").alias(key), F.col(digest_col).alias(of)))
        return named, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(of))

    rest = marked.join(*by(decided.filter("not kept or n > 1")), "left_anti")
    repeated = decided.filter("kept and n > 1")
    if not repeated.isEmpty():
        rest = rest.unionByName(marked.join(*by(repeated), "left_semi").dropDuplicates(["doc_id", mark]))
    return rest.drop(mark)


def keep_decided(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions(doc_id, text_key, kept)``, one row per row of ``docs``,
    keeps, with all their columns. Where rows repeat a kept id and text, one of them stays."""
    tally = cut(decisions.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")))
    return drop_keys(docs, text_key(), tally, "text_key")


#: An odd base for polynomial hashes modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse; kept up to the usual slice size."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    n = max(n, SLICE_BYTES + 1)
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps, dtype=np.uint64))
    if n <= 2 * SLICE_BYTES:
        _powers[:] = made
    return made[0], made[1]


def mix(z: np.ndarray) -> np.ndarray:
    """Spread a uint64 over all bits (multiply and shift)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range [start, end), from one running sum over all bytes."""
    power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
