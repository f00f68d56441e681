"""Vector operators: exact nearest neighbours, unit means, medoids, nearest centroids.

The similarity self joins cut the vectors into blocks and multiply those pairs of blocks that can hold a match, each
once, as matrices (see :mod:`kinlight.operators.blocks`). No task and no broadcast ever holds all vectors: a task has
two blocks, and keeps for each vector of either the best k of the other, which are merged per vector afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlight.functions.vectors import dot
from kinlight.operators.blocks import BLOCK, PAIR, blocks_of, matrix
from kinlight.plans.lineage import BROADCAST_ROWS, cut, is_small, join_spread

#: Defaults of the face graph.
NEIGHBOURS, SIMILARITY = 20, 0.35
#: Products of two blocks that are held at once: 64 MB.
PRODUCTS = 8 << 20


def _best(a: np.ndarray, src: np.ndarray, b: np.ndarray, dst: np.ndarray, k: int, least: float) -> list[pd.DataFrame]:
    """The best ``k`` rows of ``b`` for each row of ``a``."""
    out = []
    step = max(1, min(512, PRODUCTS // max(1, len(b))))
    for i in range(0, len(a), step):
        sim = a[i : i + step] @ b.T
        row, col = np.nonzero(sim >= least)
        other = src[i + row] != dst[col]
        row, col = row[other], col[other]
        value = sim[row, col]
        order = np.lexsort((dst[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep = nth < k
        out.append(pd.DataFrame({"src": src[i + row[keep]], "dst": dst[col[keep]], "similarity": value[keep]}))
    return out


def _best_both_ways(k: int, least: float):
    """The best ``k`` of a pair of blocks, for the rows of either; a block paired with itself comes once."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        (a, src), *other = _sides(pdf)
        if other:
            ((b, dst),) = other
            out = _best(a, src, b, dst, k, least) + _best(b, dst, a, src, k, least)
        elif pdf["cell_p"].iloc[0] == pdf["cell_q"].iloc[0] and pdf["block_p"].iloc[0] == pdf["block_q"].iloc[0]:
            out = _best(a, src, a, src, k, least)
        return pd.concat(out) if out else pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    return run


def _sides(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors and ids of one or both blocks of a pair."""
    found = [(matrix(x["vector"]), x["id"].to_numpy()) for x in (pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]) if len(x)]
    if len({v.shape[1] for v, _ in found}) > 1:
        raise ValueError("vectors differ in dimension")
    return found


def knn(vectors: DataFrame, k: int = NEIGHBOURS, least: float = SIMILARITY, block: int | None = None, id_col: str = "face_id", vector_col: str = "vector") -> DataFrame:
    """Exact k nearest neighbours by cosine of unit vectors: (src, dst, similarity, rank) for each of the
    best ``k`` others of at least ``least``; ties go to the smaller id.

    A row never matches itself, but equal vectors of different ids match. Vectors of different lengths raise;
    null vectors are left out; an empty table gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    sides = blocks_of(vectors, least, id_col, vector_col, block=block).sides()
    near = sides.groupBy(*PAIR).applyInPandas(_best_both_ways(k, least), "src long, dst long, similarity double")
    order = Window.partitionBy("src").orderBy(F.desc("similarity"), "dst")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, least: float, id_col: str = "face_id", vector_col: str = "vector", within: str | None = None, block: int | None = None) -> DataFrame:
    """All pairs a < b of at least ``least`` similarity, (a, b, similarity), by the same block products;
    with ``within``, only pairs that share that column."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = pdf["cell_p"].iloc[0] == pdf["cell_q"].iloc[0] and pdf["block_p"].iloc[0] == pdf["block_q"].iloc[0]
        found, out = _sides(pdf), []
        if same or len(found) == 2:
            (p, i), (q, j) = found[0], found[-1]
            step = max(1, min(512, PRODUCTS // len(q)))
            for at in range(0, len(p), step):
                sim = p[at : at + step] @ q.T
                row, col = np.nonzero(sim >= least)
                s, d = i[at + row], j[col]
                keep = s < d if same else s != d
                out.append(pd.DataFrame({"a": np.minimum(s, d)[keep], "b": np.maximum(s, d)[keep], "similarity": sim[row, col][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    sides = blocks_of(vectors, least, id_col, vector_col, within, block).sides()
    return sides.groupBy(*PAIR).applyInPandas(run, "a long, b long, similarity double")


def vector_sums(vectors: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """Element-wise sums per key, combined map-side: (key, sum, n). Null vectors are left out."""
    parts = vectors.filter(F.col(vector_col).isNotNull()).select(key, F.posexplode(vector_col).alias("pos", "x"))
    summed = parts.groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return summed.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sum"), F.max("n").alias("n"))


def unit_mean(vectors: DataFrame, key: str, vector_col: str = "vector", zero_as_null: bool = False) -> DataFrame:
    """The unit-length mean vector of each key: (key, centroid, n). A sum of length zero is returned as it
    is, or as null with ``zero_as_null``."""
    sums = vector_sums(vectors, key, vector_col)
    length = F.sqrt(F.aggregate("sum", F.lit(0.0).cast("double"), lambda a, x: a + x * x))
    unit = F.transform("sum", lambda x: x / F.col("_len"))
    zero = F.lit(None) if zero_as_null else F.col("sum")
    return sums.withColumn("_len", length).select(key, F.when(F.col("_len") > 0, unit).otherwise(zero).alias("centroid"), "n")


def medoid(vectors: DataFrame, key: str, id_col: str = "face_id", vector_col: str = "vector") -> DataFrame:
    """The member with the largest sum of similarities to the others of its key: (key, medoid). As the sum
    over j of v.w_j is v.S, with S the sum of all, each row needs one product. Ties go to the smaller id."""
    sums = vector_sums(vectors, key, vector_col)
    scored = join_spread(vectors.filter(F.col(vector_col).isNotNull()), sums, [key], id_col, "inner").select(key, F.col(id_col).alias("id"), (dot(vector_col, "sum") - dot(vector_col, vector_col)).alias("score"))
    return scored.groupBy(key).agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.col("id")).alias("neg"))).alias("m")).select(key, (-F.col("m.neg")).alias("medoid"))


def _nearest_of(names: np.ndarray, centroids: np.ndarray):
    """The most similar of ``centroids``, the first of equal ones, for each row of a batch (id, vector)."""
    step = min(1024, max(1, (4 << 20) // len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                rows = np.array(part.column(1).to_pylist(), float)
                if rows.ndim != 2 or rows.shape[1:] != centroids.shape[1:]:
                    raise ValueError("vectors differ in dimension")
                sim = rows @ centroids.T
                best = sim.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[best]), pa.array(sim[np.arange(len(best)), best])], ["id", "name", "similarity"])

    return run


def nearest_centroid(items: DataFrame, centroids: DataFrame, least: float = 0.5, id_col: str = "id", vector_col: str = "centroid", name_col: str = "person_id", block: int = BLOCK, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each item, the most similar centroid of at least ``least``: (id, name, similarity). Ties go to the
    smaller name. Centroids that are counted and measured to be few are sent to all tasks, and no item is
    shuffled; more than ``max_rows`` or than a broadcast may hold are met in blocks, so that neither side is held
    whole. Null and empty vectors are left out."""
    known = cut(centroids.filter(F.size(vector_col) > 0).select(F.col(name_col).cast("long").alias("name"), F.col(vector_col).alias("c")))
    rows = items.filter(F.size(vector_col) > 0).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    near = _nearest_by_rows(rows, known) if is_small(known, max_rows) else _nearest_by_blocks(rows, known, block)
    return near.filter(F.col("similarity") >= least)


def _nearest_by_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    few = known.orderBy("name").toPandas()
    if not len(few):
        return rows.select("id", F.lit(None).cast("long").alias("name"), F.lit(None).cast("double").alias("similarity"))
    found = _nearest_of(few["name"].to_numpy(), np.array(few["c"].tolist(), float))
    return rows.mapInArrow(found, "id long, name long, similarity double")


def _nearest_by_blocks(rows: DataFrame, known: DataFrame, block: int) -> DataFrame:
    n_blocks = max(1, -(-known.count() // block))
    right = known.withColumn("b", F.pmod(F.xxhash64("name"), F.lit(n_blocks)).cast("int")).select(F.col("name").alias("id"), F.col("c").alias("vector"), "b", F.lit(1).alias("side"), F.lit(None).cast("int").alias("a"))
    n_parts = max(1, -(-rows.count() // block))
    left = rows.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("a"))
    spread = right.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "name": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})
        sim = np.array(x["vector"].tolist(), float) @ np.array(y["vector"].tolist(), float).T
        best = sim.argmax(axis=1)
        return pd.DataFrame({"id": x["id"].to_numpy(), "name": y["id"].to_numpy()[best], "similarity": sim[np.arange(len(x)), best]})

    near = left.unionByName(spread).groupBy("a", "b").applyInPandas(run, "id long, name long, similarity double")
    best = near.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("name")).alias("neg"))).alias("m"))
    return best.select("id", (-F.col("m.neg")).alias("name"), F.col("m.similarity").alias("similarity"))


def batches_of(vectors: DataFrame, size: int) -> Iterator[DataFrame]:
    """The table in batches of about ``size`` rows by hash, for callers with an external index to feed."""
    n = max(1, -(-vectors.count() // size))
    for i in range(n):
        yield vectors.filter(F.pmod(F.xxhash64(*vectors.columns[:1]), F.lit(n)) == i)
