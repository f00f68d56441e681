"""Alike pictures within a time window: pairs as by brute force, and work that grows with the window's rows."""

import random
from datetime import UTC, datetime, timedelta

import pytest

from kinlight.operators import duplicates

START = datetime(2024, 5, 1, tzinfo=UTC)


def signatures(seed, n, spread=3600, unknown=0.1, changes=20):
    """Hashes near a few others, at times that crowd a little."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(128) for _ in range(6)]
    rows = []
    for i in range(n):
        bits = rng.choice(bases)
        for _ in range(rng.randrange(changes)):
            bits ^= 1 << rng.randrange(128)
        taken = None if rng.random() < unknown else START + timedelta(seconds=rng.choice([rng.randrange(spread), 600, 60 * rng.randrange(60)]), microseconds=rng.choice([0, 1]))
        rows.append((i, bits, taken))
    return rows


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def table(spark, rows):
    low = (1 << 64) - 1
    data = [(i, signed(b & low), signed(b >> 64), t) for i, b, t in rows] + [(9999, None, None, START)]
    return spark.createDataFrame(data, "photo_id long, gradient long, brightness long, taken_utc timestamp")


def brute(rows, bits, seconds):
    out = {}
    for k, (i, x, t) in enumerate(rows):
        for j, y, u in rows[k + 1 :]:
            near = seconds is None or t is None or u is None or abs(t - u) <= timedelta(seconds=seconds)
            if near and (x ^ y).bit_count() <= bits:
                out[i, j] = (x ^ y).bit_count()
    return out


@pytest.mark.parametrize(("bits", "seconds", "full"), [(12, 120, 4096), (12, 60, 20), (40, 60.000001, 20), (3, 0, 10), (12, None, 4096)])
def test_as_brute_force(spark, bits, seconds, full):
    rows = signatures(bits, 160)
    got = {(r.a, r.b): r.distance for r in duplicates.timed_hash_pairs(table(spark, rows), bits, seconds, full=full).collect()}
    assert got == brute(rows, bits, seconds)


def test_meetings_grow_in_proportion(spark):
    def met(n):
        rows = [(i, i, START + timedelta(seconds=37 * i)) for i in range(n)]
        df = table(spark, rows).filter("gradient is not null").selectExpr("photo_id AS id", "gradient", "brightness", "unix_micros(taken_utc) AS at")
        return duplicates.meetings(df, 120_000_000).count()

    assert met(400) == sum(400 - k for k in (1, 2, 3))
    assert met(1600) < 4.1 * met(400)


def test_crowded_chunks_are_dealt_out(spark, monkeypatch):
    rows = [(i, (b >> 40) << 40 if i % 2 else b, t) for i, b, t in signatures(8, 160)]
    compared, calls = duplicates._compared, []
    monkeypatch.setattr(duplicates, "_compared", lambda left, right, bits, by: calls.append(by) or compared(left, right, bits, by, block=16))
    got = {(r.a, r.b): r.distance for r in duplicates.hash_pairs(table(spark, rows), 12, full=30).collect()}
    assert calls == [["key"]] and got == brute(rows, 12, None)


def test_blocks_of_each_bucket_by_its_own_rows(spark):
    at = [0] * 90 + [i + 1 for i in range(60)]
    df = spark.createDataFrame([(i, 0, 0, t, t) for i, t in enumerate(at)], "id long, gradient long, brightness long, at long, bucket long")
    seen = duplicates._compared(df, df, 40, ["bucket"], block=10)
    assert seen.count() == 90 * 90 + 60 and seen.filter("l_at <> r_at").isEmpty()
