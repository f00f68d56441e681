"""Sets of duplicates: matches within a threshold, joined transitively, ranked inside and among sets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlight.functions.hashing import ALIKE_BITS, ALIKE_SECONDS, hamming
from kinlight.functions.text import fold_case
from kinlight.operators.graph import connected_components
from kinlight.operators.vectors import similar_pairs, unit_mean
from kinlight.plans.lineage import cut, is_small, join_spread
from kinlight.plans.numbering import numbered, numbered_in_groups

FACE_SIMILARITY, PERSON_SIMILARITY = 0.92, 0.5


def sets_of(pairs: DataFrame) -> DataFrame:
    """Transitive sets of matching pairs (a, b): (member, set_id), the set named by its smallest member."""
    return connected_components(pairs).select(F.col("node").alias("member"), F.col("component").alias("set_id"))


def closest(pairs: DataFrame) -> DataFrame:
    """The best similarity of each member of ``pairs(a, b, similarity)``: (member, closest)."""
    both = pairs.select(F.col("a").alias("member"), "similarity").union(pairs.select(F.col("b").alias("member"), "similarity"))
    return both.groupBy("member").agg(F.max("similarity").alias("closest"))


#: Members of a set that one task ranks; larger sets are numbered over many tasks.
RANKED_AT_ONCE = 1_000_000


def rank_members(members: DataFrame, *order: Column | str, at_once: int = RANKED_AT_ONCE) -> DataFrame:
    """``rank`` from 1 and ``size`` inside each ``set_id``."""
    members = cut(members)
    sizes = members.groupBy("set_id").agg(F.count("*").alias("size"))
    if not sizes.filter(F.col("size") > at_once).isEmpty():
        numbered_ = numbered_in_groups(members.withColumn("_set", F.col("set_id").cast("string")), "_set", [F.col(o) if isinstance(o, str) else o for o in order])
        return join_spread(numbered_.drop("_set").withColumnRenamed("nth", "rank"), sizes, ["set_id"], "rank", "inner")
    inside = Window.partitionBy("set_id")
    return members.withColumns({"rank": F.row_number().over(inside.orderBy(*order)), "size": F.count("*").over(inside)})


def rank_sets(sets: DataFrame, *order: Column | str) -> DataFrame:
    """``set_rank`` from 1 over one row a set."""
    ranked, _ = numbered(sets, [*order, "set_id"])
    return ranked.withColumn("set_rank", F.col("row_no") + 1).drop("row_no")


def duplicate_faces(vectors: DataFrame, details: DataFrame, least: float = FACE_SIMILARITY) -> DataFrame:
    """Faces of one person that are the same picture, for all people at once: (person_id, set_id, face_id,
    closest, rank, size). ``vectors(face_id, person_id, vector)``; ``details(face_id, confirmed, face_px,
    sharpness, score)`` ranks them: confirmed, larger, sharper (unknown is 0), better scored, smaller id."""
    pairs = cut(similar_pairs(vectors, least, within="person_id"))
    members = sets_of(pairs).join(closest(pairs), "member").withColumnRenamed("member", "face_id")
    known = members.join(vectors.select("face_id", "person_id"), "face_id").join(details, "face_id", "left")
    ranked = rank_members(known, F.desc("confirmed"), F.desc("face_px"), F.coalesce("sharpness", F.lit(0.0)).desc(), F.desc("score"), "face_id")
    return ranked.select("person_id", "set_id", "face_id", "closest", "rank", "size")


def duplicate_people(centroids: DataFrame, details: DataFrame, least: float = PERSON_SIMILARITY) -> DataFrame:
    """People who look alike: (set_id, person_id, closest, photos, faces, rank, size). ``centroids(person_id,
    centroid)``; ``details(person_id, display_name, photos, faces)`` ranks by photos, faces and name."""
    pairs = cut(similar_pairs(centroids.filter(F.size("centroid") > 0), least, id_col="person_id", vector_col="centroid"))
    members = sets_of(pairs).join(closest(pairs), "member").withColumnRenamed("member", "person_id")
    known = members.join(details, "person_id", "left")
    ranked = rank_members(known, F.desc("photos"), F.desc("faces"), fold_case("display_name"), "person_id")
    return ranked.select("set_id", "person_id", "closest", "photos", "faces", "rank", "size")


def _chunks(gradient: Column, brightness: Column, chunks: int, flips: int) -> Column:
    """The 128 bits in ``chunks`` runs of nearly equal width of at most 56 bits, each with its number in the high
    bits; with ``flips`` of 1, each also with any one of its bits changed."""
    edges = [round(i * 128 / chunks) for i in range(chunks + 1)]
    keys = []
    for i, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        key = F.lit(i << 56).cast("bigint")
        for word, base in ((gradient, 0), (brightness, 64)):
            a, b = max(lo, base) - base, min(hi, base + 64) - base
            if a < b:
                part = F.shiftrightunsigned(word, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
                key = key.bitwiseOR(F.shiftleft(part, max(0, base - lo)))
        keys += [key] + [key.bitwiseXOR(F.lit(1 << bit)) for bit in range(hi - lo)] * flips
    return F.array(*keys)


#: Chunks narrower than this many bits meet too often; then blocks of hashes are compared as arrays.
LEAST_CHUNK_BITS = 8
#: Chunks of this many bits tell hashes apart well.
WIDE = 16
BLOCK = 4096


def chunk_keys(bits: int, flipped: bool) -> Column:
    """The keys by which hashes ``gradient`` and ``brightness`` meet others at most ``bits`` apart: one side takes them
    plain, the other ``flipped``, which only makes a difference where chunks would be narrow. Exact at any width."""
    chunks, flips = max(3, bits + 1), 0
    if 128 // chunks < WIDE:
        chunks, flips = max(3, bits // 2 + 1), 1
    return _chunks(F.col("gradient"), F.col("brightness"), chunks, flips if flipped else 0)


def _pairs_by_blocks(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """Compare all hashes in pairs of blocks: a task holds two blocks and gives just the pairs within reach."""
    n_blocks = max(1, -(-rows.count() // block))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    left = blocked.select(F.col("block").alias("p"), F.explode(F.sequence("block", F.lit(n_blocks - 1))).alias("q"), "id", "gradient", "brightness", F.lit(0).alias("side"))
    right = blocked.select(F.explode(F.sequence(F.lit(0), "block")).alias("p"), F.col("block").alias("q"), "id", "gradient", "brightness", F.lit(1).alias("side"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        same, out = pdf["p"].iloc[0] == pdf["q"].iloc[0], [pd.DataFrame({"a": [], "b": [], "distance": []}, dtype="int64")]
        i, j = x["id"].to_numpy(), y["id"].to_numpy()
        words = [(x[c].to_numpy(), y[c].to_numpy()) for c in ("gradient", "brightness")]
        for at in range(0, len(i), 512):
            apart = sum(np.bitwise_count((u[at : at + 512, None] ^ v[None, :]).view(np.uint64)).astype(np.int16) for u, v in words)
            row, col = np.nonzero(apart <= bits)
            a, b = i[at : at + 512][row], j[col]
            keep = a < b if same else a != b
            out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "distance": apart[row, col][keep].astype(np.int64)}))
        return pd.concat(out)

    found = left.unionByName(right).groupBy("p", "q").applyInPandas(run, "a long, b long, distance long")
    return found.select("a", "b", F.col("distance").cast("int").alias("distance"))


#: Rows that meet on a chunk or in a time bucket up to which all of them are joined; in fuller buckets hashes meet by
#: chunks or blocks, and on fuller chunks by blocks.
FULL = 4096
HASH = ("id", "gradient", "brightness")


def hash_pairs(hashes: DataFrame, bits: int = ALIKE_BITS, id_col: str = "photo_id", full: int = FULL) -> DataFrame:
    """All pairs a < b of 128-bit hashes (gradient, brightness) at most ``bits`` apart: (a, b, distance).

    Of c chunks of the hash, one at least differs in ``bits // c`` bits or fewer (pigeonhole). Pairs meet in an
    equality join on chunks and are verified. With ``bits + 1`` chunks one is equal; where those would be narrower
    than ``WIDE`` bits, half as many chunks, one of which differs in one bit at most, are joined with all their
    one-bit changes: twice the width for as many keys more. Rows of a key that more than ``full`` have are compared in
    blocks of them, which are dealt over all tasks. From 32 bits on, blocks of hashes are compared as
    arrays instead. All are exact."""
    rows = hashes.select(F.col(id_col).cast("long").alias("id"), "gradient", "brightness").filter("gradient is not null and brightness is not null")
    chunks, flips = max(3, bits + 1), 0
    if 128 // chunks < WIDE:
        chunks, flips = max(3, bits // 2 + 1), 1
    if 128 // chunks < LEAST_CHUNK_BITS:
        return _pairs_by_blocks(rows, bits, BLOCK)
    words = (F.col("gradient"), F.col("brightness"))
    rows = rows.withColumn("at", F.lit(0).cast("long"))
    left, right = (rows.select(F.explode(_chunks(*words, chunks, n)).alias("key"), *HASH, "at") for n in (flips, 0))
    # the left side has all keys of the right one
    crowded = cut(left.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > full).select("key", F.lit(True).alias("full")))
    if crowded.isEmpty():
        met = left.select("key", *_named(left, "l")).join(right.select("key", *_named(right, "r")), "key")
        found = met.withColumn("distance", _apart()).select("l_id", "r_id", "distance")
    else:
        marked = [_marked(side, crowded, "key") for side in (left, right)]
        l, r = (side.filter("full is null").select("key", *_named(side, s)) for side, s in zip(marked, "lr", strict=True))
        packed = _compared(*(side.filter("full").drop("full") for side in marked), bits, ["key"])
        found = l.join(r, "key").withColumn("distance", _apart()).select("l_id", "r_id", "distance").unionByName(packed.select("l_id", "r_id", "distance"))
    return found.filter(F.col("l_id") < F.col("r_id")).filter(F.col("distance") <= bits).groupBy(F.col("l_id").alias("a"), F.col("r_id").alias("b")).agg(F.min("distance").alias("distance"))


def _named(rows: DataFrame, side: str, *more: str) -> list[Column]:
    return [F.col(c).alias(f"{side}_{c}") for c in (*HASH, *more)]


def _apart() -> Column:
    return hamming(F.col("l_gradient"), F.col("l_brightness"), F.col("r_gradient"), F.col("r_brightness"))


def _compared(left: DataFrame, right: DataFrame, bits: int, by: list[str], block: int = BLOCK) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``by`` and hashes at most ``bits`` apart, (l_id, r_id, l_at, r_at,
    distance): each group is a grid of blocks by its own sizes, and a task compares two blocks as arrays."""
    keys = by or ["all"]
    sides = [rows if by else rows.withColumn("all", F.lit(0)) for rows in (left, right)]
    counts = [rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for rows, n in zip(sides, ("lefts", "rights"), strict=True)]
    sizes = cut(counts[0].join(counts[1], keys))
    few = is_small(sizes)
    grid = [rows.join(F.broadcast(sizes), keys) if few else join_spread(rows, sizes, keys, "id", "inner") for rows in sides]
    hashed = F.xxhash64("id")
    p = [F.pmod(hashed, F.col("lefts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("lefts") - 1))]
    q = [F.explode(F.sequence(F.lit(0), F.col("rights") - 1)), F.pmod(hashed, F.col("rights")).cast("int")]
    met = [rows.select(*keys, p[i].alias("p"), q[i].alias("q"), F.lit(i).alias("side"), *HASH, F.coalesce("at", F.lit(0)).cast("long").alias("at")) for i, rows in enumerate(grid)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        i, j = x["id"].to_numpy(), y["id"].to_numpy()
        words = [(x[c].to_numpy(), y[c].to_numpy()) for c in ("gradient", "brightness")]
        out = [pd.DataFrame({"l_id": [], "r_id": [], "l_at": [], "r_at": [], "distance": []}, dtype="int64")]
        for at in range(0, len(i), 256):
            apart = sum(np.bitwise_count((u[at : at + 256, None] ^ v[None, :]).view(np.uint64)) for u, v in words)
            row, col = np.nonzero(apart <= bits)
            out.append(pd.DataFrame({"l_id": i[at : at + 256][row], "r_id": j[col], "l_at": x["at"].to_numpy()[at : at + 256][row], "r_at": y["at"].to_numpy()[col], "distance": apart[row, col].astype(np.int64)}))
        return pd.concat(out)

    found = met[0].unionByName(met[1]).groupBy(*keys, "p", "q").applyInPandas(run, "l_id long, r_id long, l_at long, r_at long, distance long")
    return found.withColumn("distance", F.col("distance").cast("int"))


def _pairs_between(left: DataFrame, right: DataFrame, bits: int, by: list[str]) -> DataFrame:
    """Rows of ``left`` and ``right`` with equal ``by`` and hashes at most ``bits`` apart, (l_id, r_id, distance, and
    times), maybe more than once: by chunks as in :func:`hash_pairs`, or by a grid of blocks where chunks are too
    narrow."""
    chunks, flips = max(3, bits + 1), 0
    if 128 // chunks < WIDE:
        chunks, flips = max(3, bits // 2 + 1), 1
    words = (F.col("gradient"), F.col("brightness"))
    if 128 // chunks >= LEAST_CHUNK_BITS:
        l = left.select(*by, F.explode(_chunks(*words, chunks, flips)).alias("key"), *_named(left, "l", "at"))
        r = right.select(*by, F.explode(_chunks(*words, chunks, 0)).alias("key"), *_named(right, "r", "at"))
        met = l.join(r, [*by, "key"])
    else:
        return _compared(left, right, bits, by)
    return met.withColumn("distance", _apart()).filter(F.col("distance") <= bits).select("l_id", "r_id", "l_at", "r_at", "distance")


def buckets(rows: DataFrame, micros: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``rows(id, gradient, brightness, at)`` by time buckets as wide as the window, as two tables to be
    joined on ``bucket``: each row in its own one, and each in its own and the next. Rows within the window of each
    other meet there, in neighbouring buckets once, in one bucket both ways."""
    own = F.floor(F.col("at") / max(1, micros)).cast("long")
    first = rows.withColumn("bucket", own)
    return first, rows.withColumn("bucket", F.explode(F.array(own, own + 1)))


def _full_buckets(first: DataFrame, full: int) -> DataFrame:
    """Buckets in which more than ``full`` rows meet; at most twice the rows divided by ``full``."""
    n = first.groupBy("bucket").agg(F.count("*").alias("n"))
    met = n.unionByName(n.withColumn("bucket", F.col("bucket") + 1)).groupBy("bucket").agg(F.sum("n").alias("n"))
    return met.filter(F.col("n") > full).select("bucket", F.lit(True).alias("full"))


def meetings(rows: DataFrame, micros: int) -> DataFrame:
    """Pairs of rows that meet in a bucket within the window, each once, whatever their hashes."""
    first, both = buckets(rows, micros)
    l, r = first.select("bucket", *_named(first, "l", "at")), both.select("bucket", *_named(both, "r", "at"))
    return l.join(r, "bucket").filter(_within_once(micros))


def _within_once(micros: int) -> Column:
    """One of the two ways in which rows of one bucket meet, the one in which those of two meet, within the window."""
    width = max(1, micros)
    same = F.floor(F.col("l_at") / width) == F.floor(F.col("r_at") / width)
    return (F.col("l_id") != F.col("r_id")) & (~same | (F.col("l_id") < F.col("r_id"))) & (F.abs(F.col("l_at") - F.col("r_at")) <= micros)


def timed_hash_pairs(hashes: DataFrame, bits: int = ALIKE_BITS, seconds: float | None = ALIKE_SECONDS, id_col: str = "photo_id", time_col: str = "taken_utc", full: int = FULL) -> DataFrame:
    """All pairs a < b of hashes at most ``bits`` apart whose times are within ``seconds``, or one of them unknown:
    (a, b, distance). None switches the window off.

    Rows with a time meet in time buckets, so work grows with the rows in a window, not with all pairs. A bucket in
    which few rows meet is compared whole; in a fuller one hashes meet by chunks or blocks inside it. Rows without a
    time are joined with all others by their hashes, apart from the rest."""
    if seconds is None:
        return hash_pairs(hashes, bits, id_col)
    micros = int(seconds * 1_000_000)
    at = F.unix_micros(F.col(time_col).cast("timestamp"))
    rows = hashes.select(F.col(id_col).cast("long").alias("id"), "gradient", "brightness", at.alias("at")).filter("id is not null and gradient is not null and brightness is not null")
    rows = cut(rows)
    known, unknown = rows.filter("at is not null"), rows.filter("at is null")
    first, both = buckets(known, micros)
    crowded = cut(_full_buckets(first, full))
    if crowded.isEmpty():
        near = meetings(known, micros)
    else:
        marked = [_marked(side, crowded, "bucket") for side in (first, both)]
        l, r = (side.filter("full is null").select("bucket", *_named(side, s, "at")) for side, s in zip(marked, "lr", strict=True))
        near = l.join(r, "bucket").filter(_within_once(micros))
        packed = _pairs_between(*(side.filter("full").drop("full") for side in marked), bits, ["bucket"]).filter(_within_once(micros))
    found = near.withColumn("distance", _apart()).filter(F.col("distance") <= bits).select("l_id", "r_id", "distance")
    if not crowded.isEmpty():
        found = found.unionByName(packed.select("l_id", "r_id", "distance"))
    if not unknown.isEmpty():
        found = found.unionByName(_pairs_between(unknown, rows, bits, []).filter("l_id <> r_id").select("l_id", "r_id", "distance"))
    ends = found.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"), "distance")
    return ends.groupBy("a", "b").agg(F.min("distance").alias("distance"))


def _marked(rows: DataFrame, crowded: DataFrame, by: str) -> DataFrame:
    return rows.join(F.broadcast(crowded), by, "left") if is_small(crowded) else join_spread(rows, crowded, [by], "id")


def duplicate_photos(signatures: DataFrame, bits: int = ALIKE_BITS, seconds: float | None = ALIKE_SECONDS) -> DataFrame:
    """Photos that look alike and were taken within a window (an unknown time passes; None switches the
    window off): (set_id, photo_id, rank, size, distance_from_best).

    ``signatures(photo_id, gradient, brightness, sharpness, taken_utc, file_size, mtime_utc)``. Members rank by
    sharpness, size, earliest time and id; the distance is to the sharpest member, the smaller id on ties."""
    pairs = timed_hash_pairs(signatures, bits, seconds).select("a", "b")
    members = sets_of(cut(pairs)).withColumnRenamed("member", "photo_id").join(signatures, "photo_id")
    best = members.groupBy("set_id").agg(F.max(F.struct("sharpness", (-F.col("photo_id")).alias("neg"), "gradient", "brightness")).alias("best"))
    ranked = rank_members(members, F.desc("sharpness"), F.desc("file_size"), F.coalesce("taken_utc", "mtime_utc").asc(), "photo_id").join(best, "set_id")
    apart = hamming(F.col("gradient"), F.col("brightness"), F.col("best.gradient"), F.col("best.brightness"))
    return ranked.select("set_id", "photo_id", "rank", "size", apart.alias("distance_from_best"))


def set_totals(members: DataFrame, bytes_col: str = "file_size") -> DataFrame:
    """Per set: size, extras (all but the first) and recoverable bytes (theirs), with the sets' rank."""
    extra = F.col("rank") > 1
    totals = members.groupBy("set_id").agg(F.count("*").alias("size"), F.sum(extra.cast("long")).alias("extras"), F.sum(F.when(extra, F.col(bytes_col)).otherwise(0)).alias("recoverable"))
    return rank_sets(totals, F.desc("size"), F.desc("recoverable"))


def exact_copies(table: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Rows of equal content: (id, first_id, copies) of contents with two or more rows. Contents are compared
    by digest; the groups are aggregated before they are joined back."""
    keyed = table.select(F.col(id_col).alias("id"), F.md5(F.coalesce(content_col, F.lit("")).cast("binary")).alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1")
    return join_spread(keyed, groups, ["digest"], "id", "inner").select("id", "first_id", "copies")


def without_moved(members: DataFrame, moved: DataFrame, id_col: str) -> DataFrame:
    """A result without members that were moved, and without sets that then have fewer than two."""
    left = members.join(moved.select(id_col), id_col, "left_anti")
    sizes = left.groupBy("set_id").agg(F.count("*").alias("_n")).filter("_n >= 2")
    return join_spread(left, sizes, ["set_id"], id_col, "inner").select(*members.columns)


def selection(members: DataFrame, bytes_col: str = "file_size") -> DataFrame:
    """Per set, whether all of it is selected, and how much: (set_id, all_selected, selected, bytes)."""
    return members.groupBy("set_id").agg(F.bool_and("selected").alias("all_selected"), F.sum(F.col("selected").cast("long")).alias("selected"), F.sum(F.when(F.col("selected"), F.col(bytes_col)).otherwise(0)).alias("bytes"))


def person_centroids(vectors: DataFrame) -> DataFrame:
    """Unit-mean vectors of ``vectors(person_id, vector)``."""
    return unit_mean(vectors, "person_id").select("person_id", "centroid")
