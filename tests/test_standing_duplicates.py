"""Sets kept by batches: those of one run, in whatever order batches come."""

import random

import pytest
from pyspark.sql import functions as F

from kinlight.operators import duplicates
from kinlight.operators.standing_duplicates import StandingDuplicates

from .test_timed_pairs import signatures, table


def one_run(spark, rows, bits, seconds):
    found = duplicates.sets_of(duplicates.timed_hash_pairs(table(spark, rows), bits, seconds))
    return {(r.member, r.set_id) for r in found.collect()}


@pytest.mark.parametrize(("bits", "seconds", "changes", "cuts"), [(12, 300, 14, [50, 120]), (3, None, 4, [40, 40, 70, 120])])
def test_batches_in_any_order_give_the_sets_of_one_run(spark, tmp_path, bits, seconds, changes, cuts):
    rows = signatures(bits, 120, changes=changes)
    want = one_run(spark, rows, bits, seconds)
    random.Random(1).shuffle(rows)
    standing = StandingDuplicates(spark, f"file://{tmp_path}/s", bits, seconds)
    for a, b in zip([0, *cuts], cuts, strict=False):
        found = standing.add(table(spark, rows[a:b]))
    assert {(r.member, r.set_id) for r in found.collect()} == want and len({s for _, s in want}) > 2
    assert standing.batches() == len(cuts)


def test_what_a_batch_reads_and_a_stop(spark, tmp_path):
    standing = StandingDuplicates(spark, f"file://{tmp_path}/s", 2, None)
    rows = [(i, random.Random(i).getrandbits(128), None) for i in range(300)]
    standing.add(table(spark, rows))
    batch = table(spark, [(1000, rows[7][1] ^ 1, None)]).filter("photo_id = 1000")
    keys = batch.select(F.explode(duplicates.chunk_keys(2, True)).alias("key")).select(F.pmod(F.xxhash64("key"), F.lit(256)).alias("part"))
    read = standing.stored(keys)
    assert read.count() < 0.05 * 3 * 300 and "PartitionFilters: [" in read._jdf.queryExecution().toString()
    # stopped after the chunks were written: the batch doesn't count, and is written again
    batch.sparkSession.range(1).write.parquet(f"file://{tmp_path}/s/chunks/batch=2")
    assert standing.batches() == 1
    assert {(r.member, r.set_id) for r in standing.add(batch).collect()} == {(7, 7), (1000, 7)}
