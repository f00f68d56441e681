"""Bursts on a stream are those of the whole table, with rows out of order and a restart in between."""

import random
from datetime import timedelta

import pytest

from kinlight.streaming import incremental, picture_bursts

from .test_timed_pairs import START, signatures, signed

FIELDS = "photo_id long, key string, ts timestamp, gradient long, brightness long"
BITS, SECONDS = 10, 90


def made(n):
    rng = random.Random(n)
    low = (1 << 64) - 1
    rows = [(i, rng.choice(["a", "b", None]), t, signed(b & low), signed(b >> 64)) for i, b, t in signatures(n, n, spread=7200, unknown=0, changes=8)]
    return rows + [(n + 1, "a", None, 1, 1), (n + 2, "a", START, None, 1), (None, "a", START, 1, 1)]


def brute(rows):
    rows = [r for r in rows if None not in (r[0], r[2], r[3], r[4])]
    name = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, k, t, g, b in rows:
            for j, l, u, h, c in rows:
                near = k == l and abs(t - u) <= timedelta(seconds=SECONDS) and ((g ^ h) & (2**64 - 1)).bit_count() + ((b ^ c) & (2**64 - 1)).bit_count() <= BITS
                if near and name[i] != name[j]:
                    name[i] = name[j] = min(name[i], name[j])
                    changed = True
    groups = {}
    for i, k, t, *_ in rows:
        groups.setdefault(name[i], []).append((k, t))
    return {(g[0][0], b, min(t for _, t in g), max(t for _, t in g), len(g)) for b, g in groups.items() if len(g) > 1}


def found(df):
    return sorted(((r.key, r.burst_id, r.first_ts.timestamp(), r.last_ts.timestamp(), r.n) for r in df.collect()), key=str)


def expected(rows):
    return sorted(((k, b, t.timestamp(), u.timestamp(), n) for k, b, t, u, n in brute(rows)), key=str)


def test_over_a_table(spark):
    rows = made(150)
    want = expected(rows)
    assert found(picture_bursts.picture_bursts(spark.createDataFrame(rows, FIELDS), BITS, SECONDS)) == want and len(want) > 5
    assert picture_bursts.picture_bursts(spark.createDataFrame([], FIELDS), BITS, SECONDS).count() == 0


@pytest.mark.parametrize("lateness", [0, 900])
def test_stream_equals_table(spark, tmp_path, lateness):
    rows = made(200)
    rng = random.Random(7)
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    # rows come up to ``lateness`` seconds out of order
    order = sorted(rows, key=lambda r: (r[2] or START).timestamp() + rng.uniform(0, lateness))
    # far later rows move the watermark past all others; they are bursts of one
    order += [(5000 + k, key, START + timedelta(days=1 + day), 0, 0) for day in range(2) for k, key in enumerate(["a", "b", None, "c"], 10 * day)]

    def add(part):
        spark.createDataFrame(part, FIELDS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = incremental.new_rows(spark, source, spark.createDataFrame([], FIELDS).schema)
        bursts = picture_bursts.picture_bursts_on_stream(stream, BITS, SECONDS, f"{lateness} seconds")
        query = bursts.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()

    size = -(-len(order) // 5)
    for i in range(0, len(order), size):
        add(order[i : i + size])
        if i in (size, 4 * size):  # two runs: the second goes on from the first one's state
            run()
    assert found(spark.read.schema(picture_bursts.BURSTS).parquet(target)) == expected(rows)


def test_state_is_that_of_a_window():
    class State:
        exists, kept, mark = False, None, 0

        @property
        def get(self):
            return self.kept

        def getCurrentWatermarkMs(self):
            return self.mark

        def update(self, value):
            self.kept, self.exists = value, True

        def remove(self):
            self.kept, self.exists = None, False

        def setTimeoutTimestamp(self, at):
            assert at >= self.mark

    import pandas as pd

    state, track = State(), picture_bursts._tracker(0, 10_000_000)
    for step in range(50):  # one endless burst: a picture a second
        at = [(100 * step + i) * 1_000_000 for i in range(100)]
        batch = pd.DataFrame({"photo_id": range(100 * step, 100 * step + 100), "at": at, "gradient": 5, "brightness": 5})
        assert not list(track(("k",), iter([batch]), state))
        state.mark = at[-1] // 1000
    bursts, pictures = state.kept
    assert len(bursts) == picture_bursts._BURST.itemsize and len(pictures) <= 110 * picture_bursts._PICTURE.itemsize
    state.mark += 10_000
    (out,) = list(track(("k",), iter([]), state))
    assert out["n"].tolist() == [5000] and out["burst_id"].tolist() == [0] and not state.exists


def test_repeated_hashes(spark):
    rows = [(i, "k", START, 3, 3) for i in range(300)]
    got = found(picture_bursts.picture_bursts(spark.createDataFrame(rows, FIELDS), BITS, SECONDS))
    assert got == [("k", 0, START.timestamp(), START.timestamp(), 300)]
