"""Repeated passages by seed and extend.

Seeds are winnowed anchors: in every window of 13 words, the 5-word gram with the least hash. Two equal
windows choose the same anchor at the same place, so every repeated window holds a shared anchor. Documents
are joined on their anchors: each occurrence of an anchor that several documents share brings the words around
it, as far both ways as the windows that chose it reach, and matches are extended over those words. Hashes
only propose matches; a window counts as repeated when its words are equal, byte by byte, to those of a
document with a smaller id. Overlapping windows make up the maximal repeats, which are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.plans.lineage import HOT_KEYS, cut, join_spread

#: Words of a window, and of an anchor.
WINDOW = 13
ANCHOR = 5
#: Bits a shared anchor gets in the filter that tells which anchors several documents share, and the most that a part
#: of the filter has (a broadcast of 128 MB). A longer filter is cut into parts, and texts are read once for each.
BITS_AN_ANCHOR = 16
MOST_FILTER_BITS = 1 << 30
#: Windows of one anchor that a task compares by itself.
GROUP_LIMIT = 1 << 18
#: Occurrences above which an anchor tells little (or a share of 1 / HOT_KEYS of all, if that is more): its
#: windows are then compared by all their words at once, with the least id of each combined map-side.
COMMON = 10_000
#: Rows of words made at a time.
ROWS = 1 << 15


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words (n - k + 1 values), from the words' hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + words[i : i + n]
    return common.mix(out)


def _sliding_least(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each run of ``width`` values and the first place that holds it."""
    n = len(values) - width + 1
    least, place = values[:n].copy(), np.arange(n)
    for i in range(1, width):
        other = values[i : i + n]
        lower = other < least
        least[lower] = other[lower]
        place[lower] = np.flatnonzero(lower) + i
    return least, place


def anchored_windows(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int, hash_bits: int = 64):
    """Every window of a slice of documents: document, first word in the slice, its anchor's hash and its
    anchor's first word; and all words' starts, ends and each document's first word."""
    starts, ends, first = common.word_bounds(data, offsets)
    words = common.range_hashes(data, starts, ends)
    n = max(len(words) - window + 1, 0)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    whole = np.flatnonzero(doc[:n] == doc[window - 1 :]) if n else np.zeros(0, np.int64)
    grams = _grams(words, anchor) >> np.uint64(64 - hash_bits)
    least, place = _sliding_least(grams, window - anchor + 1) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return (doc[whole] if n else whole, whole, least[whole], place[whole].astype(np.int64)), (starts, ends, first)


def _slices(batch: pa.RecordBatch, window: int):
    """The batch's texts with single spaces, in slices: first document, words of it before the slice, bytes, offsets.
    A text longer than a slice comes in pieces, with each window whole in one of them."""
    data, offsets = common.buffers(batch.column("text"))
    for i, j in common.runs_of_documents(offsets):
        part = data[offsets[i] : offsets[j]]
        if common.is_long(offsets, i, j):
            for before, piece in common.pieces_of_words(part, window - 1):
                yield i, before, *common.collapse_white(piece, np.array([0, len(piece)]))
        else:
            yield i, 0, *common.collapse_white(part, offsets[i : j + 1] - offsets[i])


def _runs(of: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Where a new anchor begins among windows in text order."""
    if not len(of):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (place[1:] != place[:-1]))))


def _anchor_batches(window: int, anchor: int, hash_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in _slices(batch, window):
                (of, _, least, place), _ = anchored_windows(data, offsets, window, anchor, hash_bits)
                at = _runs(of, place)
                yield pa.RecordBatch.from_arrays([pa.array(least[at].view(np.int64)), pa.array(ids[i + of[at]].astype(np.int64))], ["anchor", "doc_id"])

    return run


def _gather(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ranges put together, and their n + 1 bounds."""
    bounds = np.concatenate(([0], np.cumsum(end - begin)))
    return data[np.repeat(begin - bounds[:-1], end - begin) + np.arange(bounds[-1])], bounds


def _binary(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    joined, bounds = _gather(data, begin, end)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)])


def _extension_batches(shared, common_anchors, bits: int, nth: int, window: int, anchor: int, hash_bits: int):
    """Anchors that the filter passes, each with the words of the windows that chose it. Each window of a
    common anchor is a row of its own, once a document (or a piece of a long one), with all places that it begins at;
    its key is spread over all tasks."""

    def rows(batch: pa.RecordBatch, doc: np.ndarray, key: np.ndarray, begin: np.ndarray, words: pa.Array, places: pa.Array) -> pa.RecordBatch:
        ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[doc].astype(np.int64)), pa.array(keys[doc]), pa.array(begin.astype(np.int64)), words, places], _EXTENDED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, often = np.frombuffer(shared.value, np.uint8), np.frombuffer(common_anchors.value, np.uint64)
        for batch in batches:
            for i, before, data, offsets in _slices(batch, window):
                found, (starts, ends, first) = anchored_windows(data, offsets, window, anchor, hash_bits)
                first = first - before  # so that places count from the document's first word
                passed = _has(flags, found[2], bits, nth)
                of, word, least, place = (x[passed] for x in found)
                alone = often[np.minimum(np.searchsorted(often, least), len(often) - 1)] == least if len(often) else np.zeros(len(of), bool)
                f, w = of[alone], word[alone]
                if len(f):
                    # one row for a document's equal windows: equal hashes are told apart by the words
                    hashes = common.range_hashes(data, starts[w], ends[w + window - 1])
                    order = np.lexsort((w, hashes, f))
                    f, w, hashes = f[order], w[order], hashes[order]
                    new = np.concatenate(([True], (f[1:] != f[:-1]) | (hashes[1:] != hashes[:-1])))
                    rep = np.maximum.accumulate(np.where(new, np.arange(len(f)), 0))
                    new |= ~_equal(data, starts[w], ends[w + window - 1], starts[w[rep]], ends[w[rep] + window - 1])
                    at = np.append(np.flatnonzero(new), len(f))
                    for j in range(0, len(at) - 1, ROWS):
                        a = at[j : j + ROWS + 1]
                        here = a[:-1]
                        places = pa.ListArray.from_arrays(pa.array(a - a[0], pa.int32()), pa.array(w[a[0] : a[-1]] - np.repeat(first[f[here]], np.diff(a))))
                        key = common.mix(hashes[here] + batch.column("doc_id").to_numpy(zero_copy_only=False)[i + f[here]].astype(np.uint64))
                        yield rows(batch, i + f[here], key, np.full(len(here), -1), _binary(data, starts[w[here]], ends[w[here] + window - 1]), places)
                of, word, least, place = (x[~alone] for x in (of, word, least, place))
                at = np.append(_runs(of, place), len(of))
                for j in range(0, len(at) - 1, ROWS):
                    here, stop = at[:-1][j : j + ROWS], at[1:][j : j + ROWS] - 1
                    yield rows(batch, i + of[here], least[here], word[here] - first[of[here]], _binary(data, starts[word[here]], ends[word[stop] + window - 1]), pa.nulls(len(here), pa.list_(pa.int64())))

    return run


_EXTENDED_NAMES = ["anchor", "doc_id", "text_key", "begin", "words", "places"]
_EXTENDED = "anchor long, doc_id long, text_key long, begin long, words binary, places array<long>"


def _equal(data: np.ndarray, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range [a, a_end) are those of [b, b_end)."""
    out = a_end - a == b_end - b
    for i in range(0, len(a), ROWS):
        part = np.flatnonzero(out[i : i + ROWS]) + i
        part = part[a[part] != b[part]]
        if len(part):
            (x, bounds), (y, _) = _gather(data, a[part], a_end[part]), _gather(data, b[part], b_end[part])
            wrong = np.flatnonzero(x != y)
            out[part[np.unique(np.searchsorted(bounds, wrong, side="right") - 1)]] = False
    return out


def _bit(hashes: np.ndarray, bits: int) -> np.ndarray:
    return common.mix(hashes).astype(np.int64) & (bits - 1)


def _has(flags: np.ndarray, hashes: np.ndarray, bits: int, part: int) -> np.ndarray:
    """Which hashes have their bit in this part of a filter of ``bits`` bits, and have it set."""
    bit = _bit(hashes, bits) - part * len(flags) * 8
    here = (bit >= 0) & (bit < len(flags) * 8)
    bit = np.where(here, bit, 0)
    return here & ((flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)


def _filter_words(bits: int, first: int, last: int):
    """The 64-bit words that a task's anchors set in a filter of ``bits`` bits, from bit ``first`` up to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(_bit(batch.column("anchor").to_numpy(zero_copy_only=False).view(np.uint64), bits))
            bit = bit[(bit >= first) & (bit < last)] - first
            at, new = np.unique(bit >> 6, return_index=True)
            words = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), new) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words.view(np.int64))], ["at", "word"])

    return run


def _shared_filter(anchors: DataFrame, often: int) -> tuple[list, object, int]:
    """Broadcast a bitmap of the anchors that two or more documents have, in as many parts as its size by their number
    asks for, and a sorted list of the common ones; and the bitmap's size in bits. Smallest and largest ids are combined
    map-side, so a frequent anchor is one row a task."""
    several = cut(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a < b").select("anchor", "n"))
    n, total = several.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = 1 << max(6, (BITS_AN_ANCHOR * n - 1).bit_length())
    each = min(bits, MOST_FILTER_BITS)
    context = anchors.sparkSession.sparkContext
    parts = []
    for first in range(0, bits, each):
        words = several.select("anchor").mapInArrow(common.trimmed(_filter_words(bits, first, first + each)), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
        flags = np.zeros(each // 64, np.int64)
        held = words.toArrow()  # one row a word of the part at most
        flags[held.column("at").to_numpy()] = held.column("word").to_numpy()
        parts.append(context.broadcast(flags.tobytes()))
    # at most HOT_KEYS anchors can have more than that share of all occurrences
    most = several.filter(F.col("n") > max(often, total // HOT_KEYS)).select("anchor").toArrow().column("anchor").to_numpy()
    return parts, context.broadcast(np.sort(most.view(np.uint64)).tobytes()), bits


def _spans(doc: np.ndarray, key: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Runs of consecutive first words: (doc, text_key, first, last)."""
    if not len(doc):
        return [doc, key, begin, begin]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (begin[1:] != begin[:-1] + 1))))
    return [doc[new], key[new], begin[new], begin[np.append(new[1:], len(doc)) - 1]]


def _repeated(anchor: np.ndarray, doc: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The windows whose bytes a window of the same anchor in a document with a smaller id has."""
    order = np.lexsort((doc, hashes, anchor))
    a, h, d = anchor[order], hashes[order], doc[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1]))) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    hit = d > d[first] if len(order) else new
    mine, other = order[hit], order[first[hit]]
    same = _equal(data, begin[mine], end[mine], begin[other], end[other])
    if same.all():
        return mine
    # different words under one hash: the groups with such are told apart by the words themselves
    group = np.cumsum(new) - 1
    torn = np.isin(group, group[np.flatnonzero(hit)[~same]])
    raw, least, found = data.tobytes(), {}, []
    for i in order[torn]:  # by falling anchors and rising ids, so the first one has the least id
        words = (anchor[i], raw[begin[i] : end[i]])
        if least.setdefault(words, doc[i]) < doc[i]:
            found.append(i)
    return np.concatenate((mine[~torn[np.flatnonzero(hit)]], np.array(found, np.int64)))


def _matcher(window: int, limit: int, hash_bits: int):
    """From extensions sorted by anchor: spans of windows that a smaller document has, as (doc_id, text_key,
    first, last, null, null). Windows of common anchors, and of an anchor with more than ``limit`` of them, come
    out as (doc_id, text_key, null, null, words, places) instead. Holds one batch and one anchor's windows."""
    names = ["doc_id", "text_key", "first", "last", "words", "places"]

    def windows(held: pa.Table) -> tuple:
        rows = held.combine_chunks()
        data, offsets = common.buffers(rows.column("words"))
        starts, ends, first = common.word_bounds(data, offsets)
        n = np.diff(first) - window + 1
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        word = first[row] + nth
        anchor, doc, key, begin = (rows.column(c).to_numpy() for c in ("anchor", "doc_id", "text_key", "begin"))
        return anchor[row], doc[row], key[row], begin[row] + nth, data, starts[word], ends[word + window - 1]

    def repeats(held: pa.Table) -> pa.RecordBatch:
        anchor, doc, key, first, data, begin, end = windows(held)
        hit = _repeated(anchor, doc, data, begin, end, common.range_hashes(data, begin, end) >> np.uint64(64 - hash_bits))
        hit = hit[np.lexsort((first[hit], key[hit], doc[hit]))]
        out = _spans(doc[hit], key[hit], first[hit])
        return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.nulls(len(out[0]), pa.binary()), pa.nulls(len(out[0]), pa.list_(pa.int64()))], names)

    def single(held: pa.Table) -> Iterator[pa.RecordBatch]:
        _, doc, key, first, data, begin, end = windows(held)
        for i in range(0, len(doc), ROWS):
            part = slice(i, i + ROWS)
            n = len(doc[part])
            places = pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(first[part]))
            yield pa.RecordBatch.from_arrays([pa.array(doc[part]), pa.array(key[part]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), _binary(data, begin[part], end[part]), places], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        large = None
        for batch in batches:
            alone = np.asarray(batch.column("places").is_valid())
            if alone.any():
                part = batch.filter(pa.array(alone))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), part.column("words"), part.column("places")], names)
                batch = batch.filter(pa.array(~alone))
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if large is not None:
                more = int(np.searchsorted(anchor, large, side="right"))
                if more:
                    yield from single(pa.Table.from_batches([batch.slice(0, more)]))
                    batch, anchor = batch.slice(more), anchor[more:]
                if not len(anchor):
                    continue
                large = None
            held.append(batch)
            if held[0].column("anchor")[0].as_py() != anchor[-1]:
                whole = int(np.searchsorted(anchor, anchor[-1], side="left"))
                yield repeats(pa.Table.from_batches([*held[:-1], batch.slice(0, whole)]))
                held = [batch.slice(whole)]
            if sum(x.num_rows for x in held) * (window - ANCHOR + 1) > limit:
                large = anchor[-1]
                for x in held:
                    yield from single(pa.Table.from_batches([x]))
                held = []
        if held:
            yield repeats(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, limit: int = GROUP_LIMIT, often: int = COMMON, hash_bits: int = 64) -> DataFrame:
    """(doc_id, text_key, ranges): for each document with repeats, its maximal repeats, as first words and the
    words after the last ones in turn. They are made up of the windows whose words also start a window of a
    document with a smaller id. ``hash_bits`` is how much of the hashes is used; it changes no result."""
    named = docs.filter("doc_id is not null")
    anchors = named.select("doc_id", "text").mapInArrow(common.trimmed(_anchor_batches(window, anchor, hash_bits)), "anchor long, doc_id long")
    parts, most, bits = _shared_filter(anchors, often)
    keyed = named.select("doc_id", common.text_key().alias("text_key"), "text")
    each = [keyed.mapInArrow(common.trimmed(_extension_batches(part, most, bits, nth, window, anchor, hash_bits)), _EXTENDED) for nth, part in enumerate(parts)]
    extended = reduce(DataFrame.unionByName, each)
    sorted_by = extended.repartition("anchor").sortWithinPartitions("anchor")
    found = cut(sorted_by.mapInArrow(common.trimmed(_matcher(window, limit, hash_bits)), "doc_id long, text_key long, first long, last long, words binary, places array<long>"))
    spans = found.filter("words is null").select("doc_id", "text_key", "first", "last")
    large = found.filter("words is not null").select("doc_id", "text_key", "words", "places")
    if not large.isEmpty():
        least = large.groupBy("words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").select("words", "least")
        again = join_spread(large, least, ["words"], "doc_id", how="inner").filter("doc_id > least")
        spans = spans.unionByName(again.select("doc_id", "text_key", F.explode("places").alias("first")).withColumn("last", F.col("first")))
    lists = spans.groupBy("doc_id", "text_key").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    return lists.mapInArrow(common.trimmed(_merged(window)), "doc_id long, text_key long, ranges array<int>")


def _merged(window: int):
    """Puts the spans of a document that overlap or touch together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).flatten().to_numpy() for c in ("first", "last"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("first").offsets.to_numpy()))
            apart = int(last.max(initial=0)) + window + 1  # rows can't meet with this between them
            order = np.lexsort((first, row))
            begin, end = (first + row * apart)[order], (last + window + row * apart)[order]
            upto = np.maximum.accumulate(end) if len(end) else end
            new = np.flatnonzero(np.concatenate(([True], begin[1:] > upto[:-1]))) if len(end) else end
            stop = upto[np.append(new[1:], len(upto)) - 1] if len(end) else end
            of = row[order][new]
            both = np.column_stack((begin[new], stop)) - (of * apart)[:, None]
            bounds = np.concatenate(([0], np.cumsum(2 * np.bincount(of, minlength=batch.num_rows))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(both.ravel(), pa.int32()))], ["doc_id", "text_key", "ranges"])

    return run


def _kept(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space: bytes and n + 1 bounds."""
    word = np.flatnonzero(keep)
    upto = np.concatenate(([0], np.cumsum(keep)))[first]  # kept words before each document
    size = ends[word] - starts[word] + 1
    joined, bounds = _gather(np.append(data, np.uint8(32)), starts[word], starts[word] + size)
    joined[bounds[1:] - 1] = 32
    stay = np.ones(len(joined), bool)
    stay[bounds[upto[1:][np.diff(upto) > 0]] - 1] = False  # no space after a document's last word
    return joined[stay], bounds[upto] - np.concatenate(([0], np.cumsum(np.diff(upto) > 0)))


def _cut(data: np.ndarray, offsets: np.ndarray, size: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The kept texts of some documents (bytes and n + 1 bounds), their numbers of words and of removed words;
    ``size`` is how many of ``ranges`` (first words and ends) each has."""
    starts, ends, first = common.word_bounds(data, offsets)
    both = ranges + np.repeat(first[:-1], size)[:, None]
    gone = np.zeros(len(starts) + 1, np.int64)
    np.add.at(gone, both[:, 0], 1)
    np.add.at(gone, both[:, 1], -1)
    keep = gone[:-1].cumsum() == 0
    joined, bounds = _kept(data, starts, ends, first, keep)
    total = np.diff(first)
    return joined, bounds, total, total - np.diff(np.concatenate(([0], np.cumsum(keep)))[first])


def _cut_long(data: np.ndarray, ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one text longer than a slice, in pieces."""
    kept, total, removed = [], 0, 0
    for before, piece in common.pieces_of_words(data, 0):
        words = len(common.word_bounds(piece, np.array([0, len(piece)]))[0])
        local = np.clip(ranges - before, 0, words)
        local = local[local[:, 0] < local[:, 1]]
        joined, _, n, gone = _cut(piece, np.array([0, len(piece)]), np.array([len(local)]), local)
        total, removed = total + n, removed + gone
        if len(joined):
            kept += [np.array([32], np.uint8), joined] if kept else [joined]
    joined = np.concatenate([*kept, np.zeros(0, np.uint8)])
    return joined, np.array([0, len(joined)]), total, removed


def _cutter():
    names = ["doc_id", "text_key", "n_words", "n_removed", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            for i, j in common.runs_of_documents(offsets):
                part, local = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                ranges = batch.column("ranges").slice(i, j - i)
                size = np.diff(ranges.offsets.to_numpy()) // 2
                size[np.asarray(ranges.is_null())] = 0
                both = ranges.flatten().to_numpy().reshape(-1, 2)
                joined, bounds, total, removed = _cut_long(part, both) if common.is_long(offsets, i, j) else _cut(part, local, size, both)
                texts = pa.Array.from_buffers(pa.string(), j - i, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(joined)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("text_key").slice(i, j - i), pa.array(total), pa.array(removed), texts], names)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut repeated passages: doc_id, text_key, n_words, n_removed and kept_text (the words left, joined by
    one space) for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word is removed if a window of ``window`` consecutive
    words covers it whose words also start a window in a document with a smaller id; windows are judged on
    the input. Of a passage that several documents have, that of the smallest id stays. Rows that share an
    id are not repeats of each other; a row without an id neither loses words nor makes others lose them.
    Null and empty texts have no words. An empty table gives an empty result; other columns are ignored.

    Shuffled are two numbers for each winnowed anchor (about a fifth of the words), the words around the shared
    ones, and the texts once, to meet the ranges to cut: one plan for all sizes. A text longer than a slice
    is worked on in pieces, so that memory is a few bytes for each of its bytes.
    """
    common.small_text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spans = cut(repeated_spans(docs, window, anchor))
    keyed = docs.withColumn("text_key", common.text_key())
    # hashed, not sorted: the texts flow past a partition's ranges and are spilt nowhere
    joined = keyed.join(spans.hint("shuffle_hash"), ["doc_id", "text_key"], "left").select("doc_id", "text_key", "text", "ranges")
    return joined.mapInArrow(common.trimmed(_cutter()), "doc_id long, text_key long, n_words long, n_removed long, kept_text string")


def digest(texts: DataFrame) -> DataFrame:
    """Replace kept_text by its SHA-256."""
    return texts.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
