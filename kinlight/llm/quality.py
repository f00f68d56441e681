"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned features and kept as flat arrays, so that scoring walks all
trees of all documents of a batch with a few numpy look-ups per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common

#: Labelled rows that training uses at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 150, 4, 64, 0.1, 1.0, 3.0

#: Classes of UTF-8 bytes; the first of each pair names a feature.
BYTE_CLASSES = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digit": "0123456789",
    "exclamation": "!",
    "bar": "|",
    "symbol": "#$%&*+=<>@^_`~{}[]\\/",
    "stop": ".,;:?",
    "quote": "'\"()-",
    "newline": "\n",
    "space": " \t\r\v\f",
}
WORD_FEATURES = ["log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "distinct_words", "top_word", "same_as_last", "short_words", "upper_words", "symbol_ends", "stop_ends", "distinct_lines", "words_a_line", "byte_entropy"]
FEATURES = [*BYTE_CLASSES, "other_ascii", "non_ascii", *WORD_FEATURES]

_CLASS = np.full(256, len(BYTE_CLASSES), np.uint8)
_CLASS[128:] = len(BYTE_CLASSES) + 1
for _i, _chars in enumerate(BYTE_CLASSES.values()):
    _CLASS[[ord(c) for c in _chars]] = _i
_CLASSES = len(BYTE_CLASSES) + 2
_ENDS_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:?"])
_ENDS_SYMBOL = np.isin(_CLASS, [list(BYTE_CLASSES).index(c) for c in ("exclamation", "bar", "symbol")])


def _sum(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, weights=values, minlength=n)


def _diversity(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the number of distinct hashes and how often the commonest occurs."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    edge = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1]))))
    size = np.diff(np.append(edge, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, d[edge], size)
    return np.bincount(d[edge], minlength=n).astype(float), top


def _sums(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What adds up over parts of a document (a row a document: bytes by class, then words, their lengths, squared lengths,
    and four kinds of them), its longest word, and of all words the hashes and the documents."""
    n = len(offsets) - 1
    classes = np.bincount(np.repeat(np.arange(n), np.diff(offsets)) * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES)
    starts, ends, first = common.word_bounds(data, offsets)
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    length = (ends - starts).astype(float)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    uppers = np.concatenate(([0], np.cumsum(_CLASS[data] == 0)))
    shouted = (uppers[ends] - uppers[starts]) * 2 > length
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    kinds = [_sum(x.astype(float), doc, n) for x in (length, length * length, length <= 2, shouted, _ENDS_SYMBOL[last], _ENDS_STOP[last])]
    return np.column_stack([classes, words, *kinds]), longest, common.range_hashes(data, starts, ends), doc


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines and distinct lines of every document."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    inside = (line_starts < len(data)) & (line_doc < n)
    line_starts, line_doc = line_starts[inside], line_doc[inside]
    line_ends = np.append(line_starts[1:], len(data))
    distinct, _ = _diversity(common.range_hashes(data, line_starts, line_ends), line_doc, n)
    return np.bincount(line_doc, minlength=n), distinct


def _lines_of_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for one text longer than a slice: its lines are hashed one after the other."""
    stops = np.append(np.flatnonzero(data == 10) + 1, len(data))
    stops = stops[: len(stops) - 1] if len(stops) > 1 and stops[-2] == len(data) else stops
    starts = np.concatenate(([0], stops[:-1]))
    view = memoryview(data)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(view[i:j]) for i, j in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    return np.array([len(hashes)]), np.array([float(len(np.unique(hashes)))])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of every document (n x len(FEATURES)); an empty text has zeros. One document longer than a slice
    is summed up in pieces; of that, hashes of all words are held at once (8 bytes each)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    if common.is_long(offsets, 0, n):
        each = [_sums(np.ascontiguousarray(piece), np.array([0, len(piece)])) for piece in common.tiles(data)]
        sums, longest = np.sum([e[0] for e in each], axis=0), np.max([e[1] for e in each], axis=0)
        hashes = np.concatenate([e[2] for e in each])
        doc = np.zeros(len(hashes), np.int64)
        lines, distinct_lines = _lines_of_long(np.ascontiguousarray(data))
    else:
        sums, longest, hashes, doc = _sums(data, offsets)
        lines, distinct_lines = _lines(data, offsets)
    share = sums[:, :_CLASSES] / np.maximum(size, 1)[:, None]
    words, lengths, squares, short, shouted, symbol_ends, stop_ends = sums[:, _CLASSES:].T
    some = np.maximum(words, 1)
    mean = lengths / some
    spread = np.sqrt(np.maximum(squares / some - mean * mean, 0))
    distinct, top = _diversity(hashes, doc, n)
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    entropy = -np.sum(share * np.log(np.where(share > 0, share, 1)), axis=1)
    rest = [np.log1p(size), np.log1p(words), mean, spread, longest, distinct / some, top / some, _sum(again, doc, n) / some, short / some, shouted / some, symbol_ends / some, stop_ends / some, distinct_lines / np.maximum(lines, 1), words / np.maximum(lines, 1), entropy]
    return np.column_stack([share, *rest])


@dataclass
class Forest:
    """Trees of one depth in heap order: node i has children 2i + 1 and 2i + 2. ``feature`` and
    ``threshold`` are trees x inner nodes, ``leaf`` is trees x leaves; ``base`` is the first log-odds;
    ``rows`` is how many labelled rows it was learnt from."""

    rows: int
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        node = np.zeros((len(x), trees), np.int32)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            right = x[row, self.feature[tree, node]] > self.threshold[tree, node]
            node = 2 * node + 1 + right
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Boost regression trees on the logistic loss. Labels all equal give a constant score near them, and no
    labels give 0.5."""
    inner = 2**depth - 1
    p = (y.sum() + 0.5) / (len(y) + 1)
    forest = Forest(len(y), float(np.log(p / (1 - p))), np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    if not len(y) or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    n_features, flat = x.shape[1], np.arange(x.shape[1]) * bins
    margin = np.full(len(y), forest.base)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            at = ((node * n_features * bins)[:, None] + flat[None, :] + binned).ravel()
            cells = width * n_features * bins
            g = np.bincount(at, np.repeat(grad, n_features), cells).reshape(width, n_features, bins).cumsum(axis=2)
            h = np.bincount(at, np.repeat(hess, n_features), cells).reshape(width, n_features, bins).cumsum(axis=2)
            gr, hr = g[:, :, -1:] - g, h[:, :, -1:] - h
            gain = g**2 / (h + RIDGE) + gr**2 / (hr + RIDGE) - g[:, :, -1:] ** 2 / (h[:, :, -1:] + RIDGE)
            gain[(h < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            feature, at_bin = np.divmod(best, bins)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            for w in np.flatnonzero(good):
                edges = cuts[feature[w]]
                if at_bin[w] < len(edges):
                    forest.feature[t, first + w], forest.threshold[t, first + w] = feature[w], edges[at_bin[w]]
            right = x[np.arange(len(y)), forest.feature[t, first + node]] > forest.threshold[t, first + node]
            node = 2 * node + right
        g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
        forest.leaf[t] = -rate * g / (h + RIDGE)
        margin += forest.leaf[t][node]
    return forest


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.buffers(batch.column("text"))
        for i, j in common.runs_of_documents(offsets):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest:
    """Fit on at most ``sample_rows`` labelled documents whose fold (crc32 of the id as text, modulo 4)
    isn't 2: those whose ids hash lowest. Labels without a value don't count; of an id with several,
    the least does; of an id with several texts, the one whose statistics sort first does. Documents are read
    with the sampled ids broadcast, so no text is shuffled, and the fit doesn't depend on partitions."""
    common.small_text_batches(docs.sparkSession)
    usable = labels.filter("doc_id is not null and quality is not null").filter(fold() != 2).groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("label").cast("double"), "text")
    each = labelled.mapInArrow(common.trimmed(_feature_batches), "doc_id long, label double, x array<double>")
    rows = each.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("x").alias("x")).collect()  # sample_rows at most
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r.label for r in rows]))


def fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))


def _scorer(forest: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            out = [forest.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in common.runs_of_documents(offsets)]
            scores = np.concatenate([*out, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(scores)], ["doc_id", "text_key", "score"])

    return run


def score(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, held_out, score and predicted (score >= ``threshold``) for each row of ``docs``.

    The score depends on the text alone; if nothing was learnt it is 0.5. Null text counts as empty; empty texts get a score like any
    other. Null ids are not held out. Repeated rows come out as often as they came in, and an empty
    table gives an empty result. A task holds one Arrow batch, and of a text longer than a slice a piece and the
    hashes of its words.
    """
    common.small_text_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("text_key"), "text")
    scored = rows.mapInArrow(common.trimmed(_scorer(forest)), "doc_id long, text_key long, score double")
    return scored.select("doc_id", "text_key", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted as good, with all their columns, in one pass over the texts.

    Null and empty texts are scored like any other, rows without an id too; of repeated rows all stay or none.
    If nothing was learnt, as there are no labels, all rows stay. An empty table gives an empty result. Columns
    may have any names beside ``text``.
    """
    if not forest.rows:
        return docs
    common.small_text_batches(docs.sparkSession)
    return docs.mapInArrow(common.trimmed(_good(forest, threshold)), docs.schema)


def _good(forest: Forest, threshold: float):
    """Batches with the rows that score ``threshold`` or more. Rows go through Python whole: beside a column that is
    computed there, Spark would hold all rows of a task back until their scores come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = common.buffers(batch.column("text"))
            out = [forest.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) for i, j in common.runs_of_documents(offsets)]
            yield batch.filter(pa.array(np.concatenate([*out, np.zeros(0)]) >= threshold))

    return run
