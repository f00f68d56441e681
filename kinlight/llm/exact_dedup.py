"""Exact duplicates by composable polynomial fingerprints.

A text's fingerprint is its length with two polynomial hashes modulo 31-bit primes. Hashes of
adjacent parts combine as H(ab) = H(a) * r^len(b) + H(b), so the parts of one huge document are
hashed by many tasks and put together from three numbers each. Only texts whose fingerprints
are equal are read again and compared chunk by chunk with the text of their group's first document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.plans.lineage import broadcast_if_small, cut, join_spread

#: The primes 2^31 - 1 and 2^31 - 19, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1203956147, 1747591823)
#: Bytes hashed by one row of the matrix product; 256 * 2^31 * CHUNK must stay below 2^53.
CHUNK = 1024
#: Texts of more bytes than this are cut into segments that separate tasks hash.
HUGE_BYTES = 16 << 20
SEGMENT_CHARS = 4 << 20
#: Characters compared at a time.
COMPARE_CHARS = 1 << 18

WHITE_RUN = r"[\x20\x09-\x0D]+"


def _powers() -> np.ndarray:
    table = np.zeros((CHUNK, 2))
    for k, (p, r) in enumerate(zip(PRIMES, BASES, strict=True)):
        value = 1
        for i in range(CHUNK - 1, -1, -1):
            table[i, k] = value
            value = value * r % p
    return table


def combine(left: tuple[int, int, int], right: tuple[int, int, int]) -> tuple[int, int, int]:
    """The (length, hash, hash) of two adjacent parts put together."""
    (n, *a), (m, *b) = left, right
    h = [(x * pow(r, m, p) + y) % p for x, y, p, r in zip(a, b, PRIMES, BASES, strict=True)]
    return n + m, h[0], h[1]


def _weights(most: int, k: int) -> np.ndarray:
    """r^(CHUNK * i) modulo the prime, for i below ``most``."""
    step, out = pow(BASES[k], CHUNK, PRIMES[k]), np.empty(most, np.uint64)
    value = 1
    for i in range(most):
        out[i] = value
        value = value * step % PRIMES[k]
    return out


def hash_documents(data: np.ndarray, offsets: np.ndarray, powers: np.ndarray | None = None) -> np.ndarray:
    """Both hashes of every document (n x 2). Chunks are aligned at the end of a document, so only
    its first chunk is short, and leading zeros don't change a polynomial."""
    powers = _powers() if powers is None else powers
    lengths = np.diff(offsets)
    chunks = -(-lengths // CHUNK)
    last = np.cumsum(chunks)
    padded = np.zeros(int(last[-1]) * CHUNK if len(last) else 0)
    for end, i, j in zip((last * CHUNK).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        padded[end - (j - i) : end] = data[i:j]
        padded[end - (j - i) : end] += 1.0
    parts = padded.reshape(-1, CHUNK) @ powers
    out = np.zeros((len(lengths), 2), np.uint64)
    full = np.flatnonzero(chunks)
    if len(full):
        behind = np.repeat(last, chunks) - 1 - np.arange(int(last[-1]))
        for k in range(2):
            p = np.uint64(PRIMES[k])
            value = parts[:, k].astype(np.uint64) % p * _weights(int(chunks.max()), k)[behind] % p
            out[full, k] = np.add.reduceat(value, (last - chunks)[full]) % p
    return out


def _pack(h: np.ndarray) -> np.ndarray:
    return (h[:, 0] << np.uint64(31) | h[:, 1]).astype(np.int64)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    for batch in batches:
        data, offsets = common.buffers(batch.column(1))
        for i, j in common.runs_of_documents(offsets):
            base = offsets[i]
            text, ends = common.collapse_white(data[base : offsets[j]], offsets[i : j + 1] - base)
            view = memoryview(text)
            digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            h = _pack(hash_documents(text, ends, powers))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(h), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "fingerprint", "text_sha256"])


def _segment_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    for batch in batches:
        data, offsets = common.buffers(batch.column("segment"))
        h = hash_documents(data, offsets, powers).astype(np.int64)
        kept = [batch.column(c) for c in ("uid", "doc_id", "text_sha256", "k")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["uid", "doc_id", "text_sha256", "k", "n", "h1", "h2"])


def _combined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths, hashes = [], []
        for parts in batch.column("parts").to_pylist():
            whole = (0, 0, 0)
            for part in parts:
                whole = combine(whole, (part["n"], part["h1"], part["h2"]))
            lengths.append(whole[0])
            hashes.append(whole[1] << 31 | whole[2])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths, pa.int64()), pa.array(hashes, pa.int64()), batch.column("text_sha256")], ["doc_id", "n_bytes", "fingerprint", "text_sha256"])


FINGERPRINTS = "doc_id long, n_bytes long, fingerprint long, text_sha256 string"


def fingerprints(docs: DataFrame, huge_bytes: int = HUGE_BYTES, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """(doc_id, n_bytes, fingerprint, text_sha256) of the normalised text of each row of
    ``docs(doc_id, text)``; null counts as empty. Texts above ``huge_bytes`` are normalised, cut into
    segments that are dealt out and hashed apart, and combined."""
    common.small_text_batches(docs.sparkSession)
    length = F.coalesce(F.octet_length("text"), F.lit(0))
    usual = docs.filter(length <= huge_bytes).mapInArrow(common.trimmed(_fingerprint_batches), FINGERPRINTS)
    huge = docs.filter(length > huge_bytes).select("doc_id", F.regexp_replace("text", WHITE_RUN, " ").alias("text"))
    huge = huge.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text", F.sha2("text", 256).alias("text_sha256"))
    pieces = F.sequence(F.lit(0).cast("long"), F.floor((F.char_length("text") - 1) / segment_chars))
    segments = huge.select("uid", "doc_id", "text_sha256", "text", F.explode(pieces).alias("k"))
    segments = segments.select("uid", "doc_id", "text_sha256", "k", F.col("text").substr((F.col("k") * segment_chars + 1).cast("int"), F.lit(segment_chars)).alias("segment"))
    hashed = segments.repartition("uid", "k").mapInArrow(common.trimmed(_segment_batches), "uid long, doc_id long, text_sha256 string, k long, n long, h1 long, h2 long")
    parts = hashed.groupBy("uid", "doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct("k", "n", "h1", "h2"))).alias("parts"))
    return usual.unionByName(parts.mapInArrow(_combined_batches, FINGERPRINTS))


def _verified(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Compare the text of every row of ``members(doc_id, text_sha256, n_bytes, fingerprint,
    keep_id)`` with that of its group's first document, chunk by chunk; adds ``equal``."""
    normal = F.regexp_replace(F.coalesce("text", F.lit("")), WHITE_RUN, " ")
    # rows without an id are found by their digest
    named = members.withColumnRenamed("doc_id", "member_id")
    unnamed, digest = F.col("doc_id").isNull(), F.sha2(normal, 256)
    same = F.col("doc_id").eqNullSafe(F.col("member_id")) & F.when(unnamed, digest).eqNullSafe(F.when(F.col("member_id").isNull(), F.col("text_sha256")))
    texts = docs.join(broadcast_if_small(named), same).withColumn("text", normal).filter(F.sha2("text", 256) == F.col("text_sha256"))
    steps = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.char_length("text") - 1) / COMPARE_CHARS)))
    chunks = texts.withColumn("k", F.explode(steps)).withColumn("chunk", F.col("text").substr((F.col("k") * COMPARE_CHARS + 1).cast("int"), F.lit(COMPARE_CHARS)))
    chunks = chunks.select("doc_id", "text_sha256", "n_bytes", "fingerprint", "keep_id", "k", "chunk")
    keys = ["n_bytes", "fingerprint", "k"]
    first = chunks.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*keys).agg(F.min("chunk").alias("first_chunk"))
    both = join_spread(chunks, first, keys, "doc_id")
    return both.groupBy("doc_id", "n_bytes", "fingerprint", "text_sha256").agg(F.bool_and(F.coalesce(F.col("chunk") == F.col("first_chunk"), F.lit(False))).alias("equal"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """Groups of equal texts: one row per row of ``docs`` with doc_id, keep_id, group_size, kept,
    text_sha256, n_bytes, fingerprint.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space. The
    smallest id of a group stays. Null text counts as empty, and empty texts form a group like any
    other. Repeated rows (same id and text) count as copies, and exactly one of them has ``kept``.
    Null ids come after all others; a group of null ids alone keeps one row under a null keep_id. An
    empty table gives an empty result. Other columns are ignored, whatever their names.

    Memory: a task holds one Arrow batch; huge texts go by segments. Shuffled are one narrow row per
    document and the texts of groups of two or more. Groups are found by map-side combined
    aggregates and joined by salted keys, so a group may hold most of the rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(fingerprints(docs, huge_bytes).groupBy("doc_id", "n_bytes", "fingerprint", "text_sha256").agg(F.count("*").alias("repeats")))
    keys = ["n_bytes", "fingerprint"]
    groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.sum("repeats").alias("group_size"), F.count("*").alias("members"))
    found = join_spread(rows, groups, keys, "doc_id")
    several = found.filter("members > 1").select("doc_id", "text_sha256", *keys, "keep_id")
    checked = cut(_verified(docs, several))
    wrong = checked.filter("not equal")
    if not wrong.isEmpty():  # equal fingerprints of different texts: those are grouped by digest
        apart = wrong.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", *keys, "text_sha256")])
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
        for c in (*keys, "text_sha256"):
            same = same & (F.col(c) == F.col(f"_{c}"))
        rows = rows.join(apart, same, "left").withColumn("apart", F.coalesce("_text_sha256", F.lit(""))).drop(*apart.columns)
        rows = cut(rows)
        keys = [*keys, "apart"]
        groups = rows.groupBy(*keys).agg(F.min("doc_id").alias("keep_id"), F.sum("repeats").alias("group_size"))
        found = join_spread(rows, groups, keys, "doc_id")
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", "n_bytes", "fingerprint")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with all their columns, whatever their names.
    Decisions are matched by id and text, so rows that share an id but not a text are decided apart; of rows
    that share both, one stays. Null and empty texts are copies of each other. Rows without an id stay only if
    no row with one has their text, one row a text. An empty table gives an empty result."""
    found = exact_dedup(docs).select("doc_id", "text_sha256", "kept").groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    digest = F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), WHITE_RUN, " "), 256)
    return common.drop_keys(docs, digest, cut(found), "text_sha256")
