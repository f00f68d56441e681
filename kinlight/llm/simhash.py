"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two words that differ in at most ``r`` bits share a word within r / 2 bits of each: every fingerprint
emits all variants within half the radius, and equal variants meet. Over whole 64-bit words and radius
4 those are 2,081 variants each. With ``blocks=2`` the same is done in each 32-bit half: of two words
at most 4 bits apart, one half is at most 2 bits apart, so 33 variants a half suffice; the pairs that
collide are verified on all 64 bits. A collision group too large for a task is handed to the
whole-word form, whose groups can't exceed 2,081 fingerprints.

A few changed words move a fingerprint by more than 4 bits, so texts can also be linked that are
alike as sets of shingles: MinHash bands propose pairs, and the sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.operators.graph import connected_components
from kinlight.plans.lineage import broadcast_if_small, cut, join_spread

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints of one collision group that a task links by itself.
GROUP_LIMIT = 4096
#: Texts whose sets of shingles of so many words have this Jaccard share are near copies.
ALIKE_WORDS = 5
ALIKE = 0.8
#: Of pairs at a share of 0.8, bands of 4 minima each miss (1 - 0.8 ** 4) ** 16, or 2 in 10,000.
BANDS, BAND_ROWS = 16, 4
#: Shingles of the sets that a task holds while others flow past (8 bytes each), and shares of that in which a
#: band's texts are dealt out to be compared with its first one.
HELD_SHINGLES = 1 << 20
STAR_SHARES = 32
_MINIMA = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS, BAND_ROWS), np.uint64) | np.uint64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.float64)


def _shingles(starts: np.ndarray, ends: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all k-word shingles, repeats included, and for each document the index of its
    first one (n + 1 values). A document of fewer words has its whole word sequence."""
    counts = np.diff(first)
    n_shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate(([0], np.cumsum(n_shingles)))
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    begin = first[:-1][doc] + np.arange(bounds[-1]) - bounds[:-1][doc]
    last = np.minimum(begin + k, first[1:][doc]) - 1
    return starts[begin], ends[last], bounds


def _ones(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of every document's shingle hashes have each of the 64 bits, and how many hashes it has."""
    text, ends_of = common.collapse_white(_LOWER[data], offsets)
    starts, ends, first = common.word_bounds(text, ends_of)
    begin, end, bounds = _shingles(starts, ends, first, k)
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin))
    places = hashes.view(np.uint8).astype(np.int64)
    places += np.tile(np.arange(8) * 256, len(hashes))
    ones = np.zeros((len(offsets) - 1, 64))
    for d, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if j > i:
            ones[d] = (np.bincount(places[8 * i : 8 * j], minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return ones, np.diff(bounds)


def fingerprint_texts(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of every document, as uint64. One document longer than a slice is summed up in pieces."""
    if common.is_long(offsets, 0, len(offsets) - 1):
        ones, n = np.zeros((1, 64)), np.zeros(1, np.int64)
        for _, piece in common.pieces_of_words(data, k - 1):
            more, some = _ones(piece, np.array([0, len(piece)]), k)
            ones, n = ones + more, n + some
    else:
        ones, n = _ones(data, offsets, k)
    return np.packbits(ones * 2 > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.buffers(batch.column(2))
        parts = [fingerprint_texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in common.runs_of_documents(offsets)]
        values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of each row of ``docs(doc_id, text)``: fp holds the SimHash's 64 bits as
    a signed long. Null text and text without words have fingerprint zero. A task holds one Arrow batch and
    works on a slice of it, or a piece of a long text, at a time."""
    common.small_text_batches(docs.sparkSession)
    return docs.select("doc_id", common.text_key().alias("text_key"), "text").mapInArrow(common.trimmed(_fingerprint_batches), "doc_id long, text_key long, fp long")


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _variants(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """(variant, fp): all variants within half the radius that each block of the word has to spare."""
    width, half = 64 // blocks, (radius // blocks + 1) // 2
    masks = [_signed(m) for m in _masks(width, half)]

    def emitted(block: int) -> Column:
        part = F.shiftrightunsigned("fp", block * width)
        if blocks > 1:
            part = part.bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(block << width))
        return part

    parts = F.array(*[emitted(b) for b in range(blocks)])
    split = fps.select("fp", F.explode(parts).alias("part"))
    flipped = split.select("fp", "part", F.explode(F.lit(masks).cast("array<bigint>")).alias("mask"))
    return flipped.select(F.col("part").bitwiseXOR(F.col("mask")).alias("variant"), "fp")


def _close(group: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what a breadth-first search over one group's close pairs connects."""
    found = []
    rest = group
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                hits = rest[near]
                found.append((np.full(len(hits), x), hits))
                frontier.extend(hits)
                rest = rest[~near]
    return found


#: Groups up to this many fingerprints are compared by shifting whole arrays.
_SHIFTS = 16


def _linker(radius: int, limit: int):
    """Turns batches sorted by (variant, fp) into links (a, b); a group above ``limit`` comes out as
    (fp, null) rows instead. Holds one batch and one group of at most ``limit``."""

    def links(key: np.ndarray, fp: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        size = np.diff(edge)
        found = []
        in_short = np.repeat((size > 1) & (size <= _SHIFTS), size)
        k, f = key[in_short], fp[in_short]
        for shift in range(1, _SHIFTS):
            if len(k) <= shift:
                break
            same = k[shift:] == k[:-shift]
            if not same.any():
                break
            close = same & (np.bitwise_count(f[shift:] ^ f[:-shift]) <= radius)
            found.append((f[:-shift][close], f[shift:][close]))
        for i in np.flatnonzero(size > _SHIFTS):
            found += _close(fp[edge[i] : edge[i + 1]], radius)
        return found

    def out(pairs: list[tuple[np.ndarray, np.ndarray]], large: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate([p[0] for p in pairs] + [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        b = np.concatenate([p[1] for p in pairs] + [np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        for x in large:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.nulls(len(x), pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large_key = None
        for batch in batches:
            key = np.concatenate((key, batch.column(0).to_numpy(zero_copy_only=False)))
            fp = np.concatenate((fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            large = []
            if large_key is not None and len(key):
                more = int(np.searchsorted(key, large_key, side="right"))
                large.append(fp[:more])
                key, fp = key[more:], fp[more:]
            if not len(key):
                yield from out([], large)
                continue
            whole = int(np.searchsorted(key, key[-1], side="left"))
            pairs = links(key[:whole], fp[:whole]) if whole else []
            key, fp = key[whole:], fp[whole:]
            large_key = None
            if len(key) > limit:
                large_key = key[0]
                large.append(fp)
                key, fp = key[:0], fp[:0]
            yield from out(pairs, large)
        if len(key):
            yield from out(links(key, fp), [])

    return run


def near_links(fps: DataFrame, radius: int = RADIUS, blocks: int = 2, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fps(fp)`` at most ``radius`` bits apart, enough of
    them to connect all that such links connect."""
    met = _variants(fps, radius, blocks).repartition("variant").sortWithinPartitions("variant", "fp")
    found = cut(met.mapInArrow(common.trimmed(_linker(radius, limit)), "a long, b long"))
    linked = found.filter("b is not null")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if blocks > 1 and not large.isEmpty():
        whole = _variants(large, radius, 1).repartition("variant").sortWithinPartitions("variant", "fp")
        # a whole-word group holds at most all words within half the radius of its variant
        bound = len(_masks(64, (radius + 1) // 2))
        linked = linked.unionByName(whole.mapInArrow(_linker(radius, bound), "a long, b long"))
    return linked


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = ALIKE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of all documents, repeats included, and where each document's begin
    (n + 1 values). One document longer than a slice is hashed in pieces."""
    if common.is_long(offsets, 0, len(offsets) - 1):
        each = [_whole_sets(piece, np.array([0, len(piece)]), k)[0] for _, piece in common.pieces_of_words(data, k - 1)]
        hashes = np.concatenate(each)
        return hashes, np.array([0, len(hashes)])
    return _whole_sets(data, offsets, k)


def _whole_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    text, ends_of = common.collapse_white(_LOWER[data], offsets)
    begin, end, bounds = _shingles(*common.word_bounds(text, ends_of), k)
    return common.range_hashes(text, begin, end), bounds


def band_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents that have shingles, and a key for each of their bands (documents x bands)."""
    some = np.flatnonzero(np.diff(bounds))
    keys = np.zeros((len(some), BANDS), np.uint64)
    for band in range(BANDS if len(some) else 0):
        key = np.full(len(some), band, np.uint64)
        for flip, factor in zip(*_MINIMA[:, band], strict=True):
            key = common.mix(key + np.minimum.reduceat((hashes ^ flip) * factor, bounds[:-1][some]))
        keys[:, band] = key
    return some, keys


def _class_batches(k: int):
    """(text_key, fp, name, n, bands) of texts that have shingles: ``name`` is a 128-bit hash of the set of shingles,
    ``n`` its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(1))
            for i, j in common.runs_of_documents(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                hashes, bounds = shingle_sets(part, at, k)
                some, keys = band_keys(hashes, bounds)
                sets = [np.unique(hashes[bounds[d] : bounds[d + 1]]) for d in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).take(pa.array(some)),
                        pa.array(fingerprint_texts(part, at)[some].view(np.int64)),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["text_key", "fp", "name", "n", "bands"],
                )

    return run


def _set_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column(0))
            for i, j in common.runs_of_documents(offsets):
                hashes, bounds = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                names = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([names, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["name", "shingles"])

    return run


def alike_pairs(few: list[np.ndarray], many: list[np.ndarray] | None, least: float) -> list[tuple[int, int]]:
    """Links (i, j) between the sets few[i] and many[j] (few[j] without ``many``) of a Jaccard share of ``least`` or
    more, enough of them to connect what all such pairs connect. One set in ``few`` is linked to all it is alike."""
    own = many is None
    many = few if own else many
    size = np.fromiter(map(len, many), np.int64, len(many))
    order = np.argsort(size, kind="stable")
    size, bounds = size[order], np.concatenate(([0], np.cumsum(size[order])))
    words, codes = np.unique(np.concatenate([many[j] for j in order]), return_inverse=True)
    mark = np.zeros(len(words), bool)
    label = np.arange(len(many) if own else len(many) + len(few))
    found = []
    for i, x in enumerate(few):
        lo, hi = np.searchsorted(size, (least * len(x) - 1e-6, len(x) / least + 1e-6))
        if lo == hi:
            continue
        at = np.minimum(np.searchsorted(words, x), len(words) - 1)
        at = at[words[at] == x]
        mark[at] = True
        shared = np.add.reduceat(mark[codes[bounds[lo] : bounds[hi]]], bounds[lo:hi] - bounds[lo], dtype=np.int64)
        mark[at] = False
        near = order[lo:hi][shared >= least * (size[lo:hi] + len(x) - shared)]
        me = label[i if own else len(many) + i]
        others, first = np.unique(label[near], return_index=True)
        found += [(i, int(near[f])) for other, f in zip(others, first, strict=True) if other != me]
        label[np.isin(label, others)] = me
    return found


def _alike_linker(least: float):
    """Turns batches (job, side, name, fp, shingles) sorted by (job, side) into links (a, b, a_fp, b_fp). The sets of a
    job's side 0 are held and compared with each other; those of side 1 flow past them."""

    def rows(pairs: list[tuple], other: list[tuple] | None, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if pairs:
            many = held if other is None else other
            both = [(held[i], many[j]) for i, j in pairs]
            columns = [[a[0] for a, _ in both], [b[0] for _, b in both], [a[1] for a, _ in both], [b[1] for _, b in both]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.binary()] * 2 + [pa.int64()] * 2, strict=True)], ["a", "b", "a_fp", "b_fp"])

    def within(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            yield from rows(alike_pairs([h[2] for h in held], None, least), None, held)

    def passing(held: list[tuple], flow: list[tuple]) -> Iterator[pa.RecordBatch]:
        if held and flow:
            a, b = [h[2] for h in held], [f[2] for f in flow]
            swap = len(a) > len(b)
            pairs = alike_pairs(b, a, least) if swap else alike_pairs(a, b, least)
            yield from rows([(j, i) for i, j in pairs] if swap else pairs, flow, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            job, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            names, fps, sets = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [s.values.to_numpy() for s in batch.column(4)]
            edge = np.flatnonzero(np.concatenate(([True], job[1:] != job[:-1], [True])))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if job[i] != current:
                    yield from within(held)
                    current, held = job[i], []
                members = list(zip(names[i:j], fps[i:j], sets[i:j], strict=True))
                flows = int(np.searchsorted(side[i:j], 1))
                held += members[:flows]
                yield from passing(held, members[flows:])
        yield from within(held)

    return run


def _compared(roles: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b, a_fp, b_fp) that the jobs of ``roles(job, side, name)`` find."""
    met = roles.join(sets, "name").select("job", "side", "name", "fp", "shingles")
    met = met.repartition("job").sortWithinPartitions("job", "side")
    return cut(met.mapInArrow(common.trimmed(_alike_linker(least)), "a binary, b binary, a_fp long, b_fp long"))


def _star_roles(members: DataFrame, flowing: int) -> DataFrame:
    """Jobs in which each member of a band flows past the band's first one, about ``flowing`` shingles a job."""
    pairs = members.filter("name <> pivot").select("name", "pivot", "n").distinct()
    stars = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") / flowing).cast("int").alias("parts"))
    dealt = join_spread(pairs, stars, ["pivot"], "name", "inner")
    flow = dealt.select(F.xxhash64("pivot", F.pmod(F.xxhash64("name"), "parts").cast("int")).alias("job"), F.lit(1).alias("side"), "name")
    pivots = stars.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return flow.unionByName(pivots.select(F.xxhash64("pivot", "part").alias("job"), F.lit(0).alias("side"), F.col("pivot").alias("name")))


def _rest_roles(members: DataFrame, stars: DataFrame, held: int) -> DataFrame:
    """Jobs for what bands leave apart from their first member: the rest, in blocks of a ``held`` of shingles, against
    each other and against those that are alike the first."""
    linked = stars.select(F.col("a").alias("pivot"), F.col("b").alias("name")).distinct().withColumn("with", F.lit(True))
    marked = members.filter("name <> pivot").join(linked, ["name", "pivot"], "left").select("key", "name", "n", F.coalesce("with", F.lit(False)).alias("with"))

    def parts(with_first: bool) -> Column:
        return F.ceil(F.coalesce(F.sum(F.when(F.col("with") == with_first, F.col("n"))), F.lit(0)) / held).cast("int")

    blocks = marked.groupBy("key").agg(parts(False).alias("blocks"), parts(True).alias("others"), F.count("*").alias("all")).filter("blocks > 0 and all > 1").drop("all")
    dealt = join_spread(marked, blocks, ["key"], "name", "inner")
    apart, own = dealt.filter("not with"), F.pmod(F.xxhash64("name"), "blocks").cast("int")
    lanes = F.greatest("others", F.lit(1))

    def role(rows: DataFrame, side: int, block: Column | str, lane: Column | str) -> DataFrame:
        return rows.select(F.xxhash64("key", block, lane).alias("job"), F.lit(side).alias("side"), "name")

    holding = role(apart.withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))).withColumn("block", own), 0, "block", "lane")
    earlier = apart.withColumn("own", own).filter("own > 0").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("own") - 1)))
    others = dealt.filter("with").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return holding.unionByName(role(earlier, 1, "block", F.lit(0))).unionByName(role(others, 1, "block", F.pmod(F.xxhash64("name"), "others").cast("int")))


def alike_links(docs: DataFrame, k: int = ALIKE_WORDS, least: float = ALIKE, held: int = HELD_SHINGLES) -> DataFrame:
    """Links (a, b) between the fingerprints of texts of ``docs(text)`` whose sets of ``k``-word shingles have a
    Jaccard share of ``least`` or more, enough of them to connect all that the proposed pairs connect.

    Texts of equal sets are one class. Classes that share no band aren't compared; of those that do, each is compared
    with its band's first, then the rest with all others of the band. A task holds sets of about ``held`` shingles (one
    set at least) and lets others flow past. A band of many classes that are alike its first costs one comparison each;
    the classes apart from it are compared with all of the band, in blocks. Texts without words have no set and null
    texts none either; an empty table gives no links.
    """
    common.small_text_batches(docs.sparkSession)
    keyed = docs.select(common.text_key().alias("text_key"), "text")
    rows = cut(keyed.mapInArrow(common.trimmed(_class_batches(k)), "text_key long, fp long, name binary, n long, bands array<long>"))
    # equal sets have equal sizes and bands
    classes = rows.groupBy("name").agg(F.min("fp").alias("fp"), F.min("text_key").alias("text_key"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    exploded = cut(classes.select("name", "n", "fp", "text_key", F.explode("bands").alias("key")))
    bands = exploded.groupBy("key").agg(F.min("name").alias("pivot"), F.max("name").alias("_last")).filter("pivot <> _last").drop("_last")
    members = cut(join_spread(exploded, bands, ["key"], "name", "inner"))
    wanted = members.select("name", "fp", "text_key").distinct()
    texts = keyed.join(broadcast_if_small(cut(wanted.select("text_key").distinct())), "text_key", "left_semi").select("text")
    made = texts.mapInArrow(common.trimmed(_set_batches(k)), "name binary, shingles array<long>")
    sets = cut(made.groupBy("name").agg(F.first("shingles").alias("shingles")).join(wanted.select("name", "fp"), "name"))
    stars = _compared(_star_roles(members, -(-held // STAR_SHARES)), sets, least)
    rest = _compared(_rest_roles(members, stars, held), sets, least)
    equal = rows.select("name", F.col("fp").alias("b")).distinct().join(classes.select("name", F.col("fp").alias("a")), "name").select("a", "b")
    found = stars.unionByName(rest).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).unionByName(equal)
    return cut(found.filter("a <> b").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int = 2, links: DataFrame | None = None) -> DataFrame:
    """Components of near-duplicates: one row per row of ``docs`` with doc_id, text_key, fingerprint
    (16 hex digits) and component_id, the smallest id reachable over links.

    Texts are lower-cased in A-Z, cut into words at ``[\\x20\\x09-\\x0D]`` and 4-word shingles with
    repeats (fewer words: the whole sequence); a fingerprint's bit is 1 if it is set in over half the
    shingles' XXH64 values. Fingerprints link at ``radius`` or fewer differing bits. Null and empty texts
    have fingerprint zero, which links like any other. Equal fingerprints are one node, so copies cost no
    pairs. Repeated rows come out as often as they came in. A null id never names a component unless
    all ids in it are null. An empty table gives an empty result; other columns are ignored. ``links(a, b)``
    between fingerprints count besides.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = cut(fingerprints(docs))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    near = near_links(classes.select("fp"), radius, blocks)
    parts = connected_components(near if links is None else near.unionByName(links))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = join_spread(named, smallest, ["component"], "fp").select("fp", "component_id")
    found = join_spread(rows, of_class, ["fp"], "doc_id")
    return found.select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = ALIKE_WORDS, least: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each component, the one with the smallest id (and of
    rows that share that id, one), with all their columns, whatever their names. With ``least``, texts also
    link whose sets of ``words``-word shingles have that Jaccard share or more. Null and empty texts have
    fingerprint zero and are near copies of each other; rows without an id stay only in components that have no
    id at all. An empty table gives an empty result."""
    links = None if least is None else alike_links(docs, words, least)
    found = cut(near_duplicates(docs, radius=radius, links=links))
    keeper = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(F.min("text_key").alias("keeper"))
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = found.filter(own).join(keeper.withColumnRenamed("component_id", "_id"), F.col("component_id").eqNullSafe(F.col("_id")))
    decided = found.filter(~own).select("doc_id", "text_key", F.lit(False).alias("kept"))
    return common.keep_decided(docs, decided.unionByName(first.select("doc_id", "text_key", (F.col("text_key") == F.col("keeper")).alias("kept"))))
