"""Global row numbers without bringing all rows to one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.plans.lineage import cut, join_spread


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """``rows`` with ``row_no`` from 0 without gaps in the order given, and their number.

    Rows are sorted by range partitions and checkpointed, so that numbers hold when a task runs again; one count
    a partition comes to the driver and shifts the numbers inside each partition.
    """
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    local = ordered.withColumn("_at", F.monotonically_increasing_id())
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = local.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    sizes = np.zeros(max([0, *(r.part + 1 for r in counts)]), np.int64)
    for r in counts:
        sizes[r.part] = r.n
    starts = np.concatenate(([0], np.cumsum(sizes)))
    before = F.get(F.lit([int(s) for s in starts]).cast("array<bigint>"), part.cast("int"))
    return local.withColumn("row_no", before + within).drop("_at"), int(starts[-1])


def numbered_in_groups(rows: DataFrame, group: str, order: list) -> DataFrame:
    """``rows`` with ``nth`` from 1 inside each ``group`` in the order given. Rows are sorted by ranges of group and
    order, so a group with most of the rows is dealt to many tasks; null groups are one group."""
    placed, _ = numbered(rows, [group, *order])
    starts = placed.groupBy(F.coalesce(F.col(group), F.lit("")).alias("_group")).agg(F.min("row_no").alias("_start"))
    keyed = placed.withColumn("_group", F.coalesce(F.col(group), F.lit("")))
    return join_spread(keyed, starts, ["_group"], "row_no").withColumn("nth", F.col("row_no") - F.col("_start") + 1).drop("row_no", "_start", "_group")


def free_numbers(wanted: DataFrame, taken: DataFrame, group: str) -> DataFrame:
    """``wanted(<group>, nth, ...)`` with ``number``: the nth number from 1 that ``taken(<group>, number)`` hasn't in
    its group.

    The j-th taken number t has t - j free ones below it, so the nth free number lies behind the taken ones with
    t - j < n: a merge of both lists by these values counts them, with no list held whole anywhere."""
    steps = numbered_in_groups(taken.filter("number > 0").distinct(), group, ["number"])
    steps = steps.select(group, (F.col("number") - F.col("nth")).alias("_value"), F.lit(1).alias("_kind"))
    rows = wanted.withColumns({"_value": F.col("nth"), "_kind": F.lit(0)}).withColumnRenamed("nth", "_nth")
    merged = numbered_in_groups(rows.unionByName(steps, allowMissingColumns=True), group, ["_value", "_kind"])
    return merged.filter("_kind = 0").withColumn("number", F.col("nth")).drop("nth", "_value", "_kind").withColumnRenamed("_nth", "nth")
