"""Blocks of vectors for exact similarity joins, and the pairs of blocks that can hold a match.

Vectors are put into cells around pivots, each with the nearest, and a cell is cut by the angle to its pivot into
blocks of bounded size. For unit vectors the triangle inequality holds for angles: of two blocks, the pivots' angle
and the ranges of angles around them bound the angle between any two members from below, so pairs of blocks beyond
the threshold's angle are never made. The bound takes longer vectors by their largest norm. What is skipped can't
match, so joins over the rest are exact; without structure nothing is skipped, and all pairs of blocks are left.

Everything is a table: bins of angles are counted by group, cell and bin, blocks are cut from running counts, cells
of one group (at most ``PIVOTS``) are compared by one task, and blocks meet by joins on their cells. Only the
sample that pivots are chosen from comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlight.plans.lineage import broadcast_if_small, cut, join_spread

#: Vectors in a block: two blocks and their product take about 40 MB at 512 dimensions.
BLOCK = 2048
#: Blocks that a join over all vectors aims at, so that copies of a row don't grow with the table, and the most vectors
#: that a block is enlarged to for it: 16 MB at 64 dimensions, 128 MB at 512.
GRID, LARGEST = 12, 32_768
#: Pivots of a join at most; more rows than that many blocks make larger cells, not more of them.
PIVOTS = 2048
#: Vectors that pivots are chosen from, for each of them; they come to the driver.
SAMPLE = 4
#: Rings of equal angle that a cell's members are counted in.
BINS = 64
#: What rounding may take from an angle.
SLACK = 1e-6

PAIR = ["group", "cell_p", "block_p", "cell_q", "block_q"]


def matrix(blobs: pd.Series) -> np.ndarray:
    """Vectors that were packed as float64 bytes, as rows."""
    parts = blobs.tolist()
    if len({len(b) for b in parts}) > 1:
        raise ValueError("vectors differ in dimension")
    return np.frombuffer(b"".join(parts)).reshape(len(parts), -1)


def _dense(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), float)
    if rows.ndim != 2:
        raise ValueError("vectors differ in dimension")
    return rows


def spread_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Directions of up to ``n`` pivots: vectors of the sample, each the farthest from those before it, then moved to
    the mean direction of the sample's vectors around it. Any pivots are right; these make narrow cells."""
    length = np.sqrt((sample * sample).sum(1))
    unit = sample[length > 0] / length[length > 0, None]
    if not len(unit):
        return np.zeros((1, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    pivots = unit[chosen]
    home = (unit @ pivots.T).argmax(1)
    sums = np.zeros_like(pivots)
    np.add.at(sums, home, unit)
    size = np.sqrt((sums * sums).sum(1))
    return np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], pivots)


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _placing(pivots: np.ndarray | None):
    """Packs vectors and finds each one's cell among the first ``pivots`` of its group, its angle and its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _dense(batch.column("vector"))
            norm = np.sqrt((rows * rows).sum(1))
            cell, angle = np.zeros(len(rows), np.int32), np.zeros(len(rows))
            if pivots is not None:
                if rows.shape[1] != pivots.shape[1]:
                    raise ValueError("vectors differ in dimension")
                choices = batch.column("pivots").to_numpy(zero_copy_only=False)
                with np.errstate(invalid="ignore", divide="ignore"):
                    cosine = np.nan_to_num(rows @ pivots.T / norm[:, None], nan=1.0)
                for n in np.unique(choices):
                    at = np.flatnonzero(choices == n)
                    best = cosine[at, :n].argmax(1)
                    cell[at], angle[at] = best, _angles(cosine[at, best])
            packed = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), packed, pa.array(cell), pa.array(angle), pa.array(np.nan_to_num(norm, nan=np.inf))], ["id", "group", "vector", "cell", "angle", "norm"])

    return run


def _reach(norms: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The largest product of members of two blocks with angles of at least ``apart``."""
    return np.where(norms > 0, norms * np.maximum(np.cos(np.clip(apart - SLACK, 0, math.pi)), 0), 0)


def least_angle(theta, low_p, high_p, low_q, high_q):
    """The least angle between members of two blocks whose pivots are ``theta`` apart. A member of q is at
    ``theta +- high_q`` from p's pivot, and not nearer than ``low_q - theta``; likewise the other way round."""
    nearest_q, farthest_q = np.maximum(theta - high_q, low_q - theta), theta + high_q
    nearest_p, farthest_p = np.maximum(theta - high_p, low_p - theta), theta + high_p
    return np.maximum.reduce([nearest_q - high_p, low_p - farthest_q, nearest_p - high_q, low_q - farthest_p, np.zeros_like(nearest_q)])


def _pairs_of_cells(pivots: np.ndarray, least: float):
    between = _angles(pivots @ pivots.T)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf.sort_values("cell")
        no, low, high, norm = (cell[c].to_numpy() for c in ("cell", "low", "high", "norm"))
        out = []
        for i in range(len(no)):
            theta = between[no[i], no[i:]]
            apart = least_angle(theta, low[i], high[i], low[i:], high[i:])
            near = np.flatnonzero(~(_reach(norm[i] * norm[i:], apart) < least))
            out.append(pd.DataFrame({"group": pdf["group"].iloc[0], "cell_p": no[i], "cell_q": no[i:][near], "theta": theta[near]}))
        return pd.concat(out)

    return run


def _apart(theta: Column, low_p: Column, high_p: Column, low_q: Column, high_q: Column) -> Column:
    """:func:`least_angle` as a column."""
    nearest_q, farthest_q = F.greatest(theta - high_q, low_q - theta), theta + high_q
    nearest_p, farthest_p = F.greatest(theta - high_p, low_p - theta), theta + high_p
    return F.greatest(nearest_q - high_p, low_p - farthest_q, nearest_p - high_q, low_q - farthest_p, F.lit(0.0))


@dataclass
class Blocks:
    """``rows(id, group, vector, cell, block)``, vectors packed, and the ``pairs`` of blocks (``PAIR``, the lesser
    first, each block with itself, too) that can hold products of at least the threshold."""

    rows: DataFrame
    pairs: DataFrame

    def sides(self) -> DataFrame:
        """Every row once for each pair that its block is in: the pair's columns, side, id, vector."""
        p = self.pairs.select("*", F.col("cell_p").alias("cell"), F.col("block_p").alias("block"), F.lit(0).alias("side"))
        q = self.pairs.filter("cell_p <> cell_q or block_p <> block_q").select("*", F.col("cell_q").alias("cell"), F.col("block_q").alias("block"), F.lit(1).alias("side"))
        met = self.rows.join(broadcast_if_small(p.unionByName(q)), ["group", "cell", "block"])
        return met.select(*PAIR, "side", "id", "vector")


def _group_sizes(rows: DataFrame, grouped: bool, block: int) -> tuple[DataFrame, int]:
    """``rows`` with the number of pivots of their group, and the largest such number: 1 where a group fits a block."""
    wanted = F.when(F.col("n") <= block, 1).otherwise(F.least(F.lit(PIVOTS), F.ceil(2 * F.col("n") / block))).cast("int")
    if not grouped:
        n = rows.count()
        most = 1 if n <= block else min(PIVOTS, -(-2 * n // block))
        return rows.withColumn("pivots", F.lit(most)), most
    sizes = cut(rows.groupBy("group").agg(F.count("*").alias("n")).select("group", wanted.alias("pivots")))
    most = sizes.agg(F.coalesce(F.max("pivots"), F.lit(1))).first()[0]
    return (rows.withColumn("pivots", F.lit(1)) if most == 1 else join_spread(rows, sizes, ["group"], "id", "inner")), most


def blocks_of(vectors: DataFrame, least: float, id_col: str, vector_col: str, within: str | None = None, block: int | None = None) -> Blocks:
    """Blocks of at most twice ``block`` vectors (None: ``BLOCK``, and for large tables without ``within`` more), and the pairs of them that a join for products of at least
    ``least`` has to multiply. With ``within``, only rows that share that column are paired. Rows without an id or a
    vector are left out; vectors of different lengths raise."""
    spark = vectors.sparkSession
    group = F.lit(0).cast("long") if within is None else F.col(within)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), group.alias("group")).filter("id is not null and vector is not null and group is not null")
    if block is None:
        block = BLOCK if within is not None else min(LARGEST, max(BLOCK, rows.count() // GRID))
    sized, most = _group_sizes(rows, within is not None, block)
    kind = f"id long, group {rows.schema['group'].dataType.simpleString()}, vector binary, cell int, angle double, norm double"
    if most == 1:
        packed = sized.mapInArrow(_placing(None), kind)
        alone = packed.select("group").distinct().select("group", *(F.lit(0).alias(c) for c in PAIR[1:]))
        only = spark.createDataFrame([(0, 0, 0, 0, 0)], "group long, cell_p int, block_p int, cell_q int, block_q int")
        return Blocks(packed.withColumn("block", F.lit(0)), only if within is None else alone)

    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE * most).select("vector").collect()
    pivots = spread_pivots(np.array([r.vector for r in drawn], float), most)
    placed = cut(sized.mapInArrow(_placing(pivots), kind)).withColumn("bin", F.floor(F.col("angle") * (BINS / math.pi)).cast("int"))
    bins = placed.groupBy("group", "cell", "bin").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.max("norm").alias("norm"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group", "cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = cut(bins.withColumns({"first": F.floor(before / block).cast("int"), "parts": F.ceil(F.col("n") / block).cast("int")}))
    each = bins.withColumn("block", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
    extent = [F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")]
    blocks = cut(each.groupBy("group", "cell", "block").agg(*extent))
    cells = blocks.groupBy("group", "cell").agg(*extent)
    near = cells.groupBy("group").applyInPandas(_pairs_of_cells(pivots, least), f"group {rows.schema['group'].dataType.simpleString()}, cell_p int, cell_q int, theta double")
    p, q = (blocks.select("group", *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "block", "low", "high", "norm")]) for s in "pq")
    apart = _apart(*(F.col(c) for c in ("theta", "low_p", "high_p", "low_q", "high_q")))
    most_of = F.col("norm_p") * F.col("norm_q") * F.greatest(F.cos(F.greatest(apart - SLACK, F.lit(0.0))), F.lit(0.0))
    order = "cell_p < cell_q or block_p <= block_q"
    pairs = near.join(p, ["group", "cell_p"]).join(q, ["group", "cell_q"]).filter(order).filter((most_of >= least) | F.isnan(most_of)).select(*PAIR)
    share = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    where = bins.select("group", "cell", "bin", "first", "parts")
    small = broadcast_if_small(where)
    found = placed.join(small, ["group", "cell", "bin"]) if small is not where else join_spread(placed, where, ["group", "cell", "bin"], "id", "inner")
    return Blocks(found.select("id", "group", "vector", "cell", share.cast("int").alias("block")), cut(pairs))
