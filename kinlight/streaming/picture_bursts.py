"""Bursts of alike pictures, over a table and over a stream.

Two pictures of one key (a camera, a user) link when they were taken at most a gap apart and their hashes differ in few
bits; bursts are what links connect, two pictures or more. That doesn't depend on the order in which rows come, so a
stream finds the bursts of the whole table, as long as rows aren't later than its watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinlight.functions.hashing import ALIKE_BITS, ALIKE_SECONDS
from kinlight.operators.duplicates import sets_of, timed_hash_pairs
from kinlight.plans.lineage import cut

BURSTS = "key string, burst_id long, first_ts timestamp, last_ts timestamp, n long"
#: What is known of an open burst, and of a picture that may still find others.
_BURST = np.dtype([("burst", "i8"), ("first", "i8"), ("last", "i8"), ("n", "i8")])
_PICTURE = np.dtype([("burst", "i8"), ("at", "i8"), ("gradient", "u8"), ("brightness", "u8")])


def picture_bursts(pictures: DataFrame, bits: int = ALIKE_BITS, seconds: float = ALIKE_SECONDS) -> DataFrame:
    """Bursts in ``pictures(photo_id, key, ts, gradient, brightness)``: (key, burst_id, first_ts, last_ts, n), named by
    the smallest id. Rows without an id, time or hash are in none; null keys are one key. Ids are unique."""
    known = cut(pictures.select(F.col("photo_id").cast("long").alias("photo_id"), F.col("key").cast("string").alias("key"), "ts", "gradient", "brightness").dropna(subset=["photo_id", "ts", "gradient", "brightness"]))
    pairs = timed_hash_pairs(known, bits, seconds, "photo_id", "ts")
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("photo_id").alias(end), F.col("key").alias(f"{end}_key")), end)
    members = sets_of(cut(pairs.filter(F.col("a_key").eqNullSafe(F.col("b_key"))).select("a", "b")))
    joined = members.join(known.select(F.col("photo_id").alias("member"), "key", "ts"), "member")
    return joined.groupBy("set_id").agg(F.first("key").alias("key"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).select("key", F.col("set_id").alias("burst_id"), "first_ts", "last_ts", "n")


def picture_bursts_on_stream(pictures: DataFrame, bits: int = ALIKE_BITS, seconds: float = ALIKE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same bursts over a stream, each once, when the watermark is more than the gap behind its last picture. Rows
    later than ``late`` are left out.

    A key's state holds the pictures no more than the gap older than the watermark, and four numbers for each burst that
    is still open: the rows of a window, whatever went by before. A batch's rows of one key go to one task, an Arrow batch
    at a time."""
    rows = pictures.select(F.col("photo_id").cast("long").alias("photo_id"), F.col("key").cast("string").alias("key"), "ts", "gradient", "brightness").dropna(subset=["photo_id", "ts", "gradient", "brightness"])
    timed = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late)
    return timed.groupBy("key").applyInPandasWithState(_tracker(bits, int(seconds * 1_000_000)), BURSTS, "bursts binary, pictures binary", "append", GroupStateTimeout.EventTimeTimeout)


def _tracker(bits: int, gap: int):
    def track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bursts, pictures = (np.frombuffer(raw, kind) for raw, kind in zip(state.get, (_BURST, _PICTURE), strict=True)) if state.exists else (np.zeros(0, _BURST), np.zeros(0, _PICTURE))
        for batch in batches:
            bursts, pictures = joined(bursts, pictures, arrived(batch), bits, gap)
        mark = state.getCurrentWatermarkMs() * 1000
        # rows still to come are later than the watermark: what ended over a gap before it stays as it is
        ended = bursts["last"] + gap <= mark
        out = bursts[ended & (bursts["n"] > 1)]
        bursts, pictures = bursts[~ended], pictures[pictures["at"] + gap > mark]
        if len(bursts):
            state.update((bursts.tobytes(), pictures.tobytes()))
            state.setTimeoutTimestamp(int(-(-(int(bursts["last"].min()) + gap) // 1000)))
        elif state.exists:
            state.remove()
        if len(out):
            yield pd.DataFrame({"key": [key[0]] * len(out), "burst_id": out["burst"], "first_ts": _times(out["first"]), "last_ts": _times(out["last"]), "n": out["n"]})

    return track


def _times(micros: np.ndarray) -> pd.Series:
    return pd.Series(pd.to_datetime(micros, unit="us", utc=True))


def arrived(batch: pd.DataFrame) -> np.ndarray:
    """New rows, each a burst of its own."""
    out = np.zeros(len(batch), _PICTURE)
    out["burst"], out["at"] = batch["photo_id"], batch["at"]
    out["gradient"], out["brightness"] = (batch[c].to_numpy(np.int64).view(np.uint64) for c in ("gradient", "brightness"))
    return out


def joined(bursts: np.ndarray, pictures: np.ndarray, new: np.ndarray, bits: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Bursts and pictures after new rows: bursts that a link connects become one, under the smallest id."""
    fresh = np.zeros(len(new), _BURST)
    fresh["burst"], fresh["first"], fresh["last"], fresh["n"] = new["burst"], new["at"], new["at"], 1
    bursts, pictures = np.concatenate((bursts, fresh)), np.concatenate((pictures, new))
    pictures = pictures[np.argsort(pictures["at"], kind="stable")]
    names = np.unique(bursts["burst"])
    parent = np.arange(len(names))
    of = np.searchsorted(names, pictures["burst"])

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    stop = np.searchsorted(pictures["at"], pictures["at"] + gap, side="right")
    gradient, brightness = (np.ascontiguousarray(pictures[c]) for c in ("gradient", "brightness"))
    for i in np.flatnonzero(stop > np.arange(len(pictures)) + 1):
        window = slice(i + 1, stop[i])
        apart = np.bitwise_count(gradient[window] ^ gradient[i]).astype(np.int64) + np.bitwise_count(brightness[window] ^ brightness[i])
        for j in np.unique(of[window][apart <= bits]):
            a, b = root(of[i]), root(j)
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(names))], np.int64)
    at, where = np.unique(roots[np.searchsorted(names, bursts["burst"])], return_inverse=True)
    merged = np.zeros(len(at), _BURST)
    merged["burst"], merged["first"], merged["last"] = names[at], np.iinfo(np.int64).max, np.iinfo(np.int64).min
    np.minimum.at(merged["first"], where, bursts["first"])
    np.maximum.at(merged["last"], where, bursts["last"])
    np.add.at(merged["n"], where, bursts["n"])
    out = pictures.copy()
    out["burst"] = names[roots[of]]
    return merged, out
