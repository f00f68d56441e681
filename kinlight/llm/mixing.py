"""Mixing sources to target weights, by blocks of words.

A source's documents, in the order of their ids, are one stream of words, cut into blocks of a fixed length. A mix
takes a source's blocks in epochs: each whole epoch takes every block once, and the last takes as many as the target
still wants, its last block cut so that the source's words come out at the target exactly. The takes of a source are
dealt to output shards by a multinomial draw: halving the range of shards, a binomial draw says how many go left, so
that every task finds its own shards' counts, and the numbers of the takes in them, from the seed alone. The take's
number, through a pseudorandom permutation of the epoch's own, is the index of the block; blocks and documents then
join on (source, index).

What comes to the driver is one row a source (a million at most, else it raises) and one count a partition. Each
side of the join has few rows a key: a block is taken at most a few times and holds no more than ``BLOCK`` words, so
a source that has most of the rows is spread over its blocks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.llm.sharding import permuted
from kinlight.plans.lineage import broadcast_if_small, cut

#: Words a block.
BLOCK = 512
#: Takes a shard, on average.
SHARD_BLOCKS = 4096
WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
SEED = 20240229
MOST_SOURCES = 1_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MOST_EPOCHS) -> list[float]:
    """Words wanted of each source: ``share`` of all sizes by weight, none over ``most`` times its size; what is over
    goes to the others by weight, until none is above."""
    wanted, open_ = [0.0] * len(sizes), [i for i, w in enumerate(weights) if w > 0]
    left = share * sum(sizes)
    while open_:
        each = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if each * weights[i] > most * sizes[i]]
        for i in over or open_:
            wanted[i] = float(most * sizes[i]) if over else each * weights[i]
        if not over:
            break
        left -= sum(wanted[i] for i in over)
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return wanted


@dataclass
class Source:
    """A source's stream and what the mix takes of it."""

    index: int
    name: str | None
    size: int
    target: float
    seed: int
    blocks: int = 0
    takes: int = 0
    last: int = 0

    def __post_init__(self) -> None:
        """Takes, and the words of the last one: whole epochs, and of one more as many blocks as give the rest. The
        stream's last block may be shorter than the others, which counts if it is among them."""
        self.blocks = -(-self.size // BLOCK)
        words = round(self.target)
        if not self.size or not words:
            return
        epochs, rest = divmod(words, self.size)
        self.takes, self.last = epochs * self.blocks, 0
        if rest:
            short = self.blocks * BLOCK - self.size
            at = int(permuted(np.array([self.blocks - 1]), self.blocks, self._epoch_seed(epochs), inverse=True)[0])
            blocks = -(-rest // BLOCK)
            if at < blocks:
                blocks = -(-(rest + short) // BLOCK)
            self.takes += blocks
            before = (blocks - 1) * BLOCK - (short if at < blocks - 1 else 0)
            self.last = rest - before

    def _epoch_seed(self, epoch: int) -> int:
        return (self.seed + epoch * 0x9E3779B97F4A7C15) % (1 << 63)

    def block_of(self, takes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(epoch, block, words at most) of each take by its number."""
        epoch, nth = np.divmod(takes, max(self.blocks, 1))
        block = np.empty_like(takes)
        for e in np.unique(epoch):
            here = epoch == e
            block[here] = permuted(nth[here], self.blocks, self._epoch_seed(int(e)))
        words = np.full(len(takes), BLOCK)
        if self.last:
            words[takes == self.takes - 1] = self.last
        return epoch, block, words


def dealt(takes: np.ndarray, shards: int, low: int, high: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, number of each source's first take, counts) of the shards from ``low`` up to ``high``: the draw of all
    takes to ``shards`` shards, alike for whoever asks."""

    def go(a: int, b: int, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, first, counts
            return
        middle = (a + b) // 2
        left = np.random.Generator(np.random.PCG64([seed, a, b])).binomial(counts, (middle - a) / (b - a))
        yield from go(a, middle, first, left)
        yield from go(middle, b, first + left, counts - left)

    yield from go(0, shards, np.zeros_like(takes), takes)


def _words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _streamed(starts: dict[tuple[int, str | None], int], numbers: dict[str | None, int]) -> Callable[[common.Batches], common.Batches]:
    """Adds a document's source by number and where its words start in the source's stream, in a partition sorted by
    source."""

    def run(batches: common.Batches) -> common.Batches:
        from pyspark import TaskContext

        part, now, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            sources, sizes = batch.column("source").to_pylist(), batch.column("size").to_numpy()
            start, number = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int32)
            i = 0
            while i < len(sizes):
                j = i
                while j < len(sizes) and sources[j] == sources[i]:
                    j += 1
                if sources[i] != now:
                    now, at = sources[i], starts[part, sources[i]]
                ends = at + np.cumsum(sizes[i:j])
                start[i:j], number[i:j] = ends - sizes[i:j], numbers[now]
                i, at = j, int(ends[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(start)], [*batch.schema.names, "source_no", "start"])

    return run


@dataclass
class Mix:
    """A mix of documents: ``docs`` has row (a number of its own), doc_id, text_key, source, size, source_no and
    start, the words before it in its source's stream."""

    docs: DataFrame
    sources: list[Source]
    seed: int

    @property
    def shards(self) -> int:
        return max(1, -(-sum(s.takes for s in self.sources) // SHARD_BLOCKS))

    def takes(self) -> DataFrame:
        """One row a block taken: shard, slot (from 0 in each shard), source_no, epoch, block, and how many of its
        words at most."""
        spark, shards = self.docs.sparkSession, self.shards
        at_once = max(1, min(64, shards // 256))
        ranges = -(-shards // at_once)
        parts = min(ranges, max(spark.sparkContext.defaultParallelism, ranges // 16))
        schema = "shard long, slot long, source_no int, epoch long, block long, words long"
        made = spark.range(0, ranges, 1, parts).mapInArrow(_taking(self.sources, shards, at_once, self.seed), schema)
        return made.hint("merge")  # Spark takes it for as small as the range it is made from, and would broadcast it

    def _pieces(self) -> DataFrame:
        """Documents by the blocks that hold words of theirs, with those words' begin and end in the stream."""
        end = F.col("start") + F.col("size")
        blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK), F.floor((end - 1) / BLOCK)))
        none = F.array(-1 - F.col("row"))  # no block, and not one key for all that are empty
        pieces = self.docs.withColumn("block", F.explode(F.coalesce(blocks, none)))
        return pieces.withColumns({"begin": F.greatest("start", F.col("block") * BLOCK), "end": F.least(end, (F.col("block") + 1) * BLOCK)})

    def spans(self) -> DataFrame:
        """What a document gives to each block taken: shard, slot, row, doc_id, text_key, source_no, epoch, from_word
        (the document's words before), n_words, and place (the block's words before)."""
        n = F.least("end", F.col("block") * BLOCK + F.col("words")) - F.col("begin")
        joined = self._pieces().join(self.takes(), ["source_no", "block"]).withColumn("n_words", n).filter("n_words > 0")
        return joined.select("shard", "slot", "row", "doc_id", "text_key", "source_no", "epoch", (F.col("begin") - F.col("start")).alias("from_word"), "n_words", (F.col("begin") - F.col("block") * BLOCK).alias("place"))

    def taken(self) -> DataFrame:
        """One row a document: doc_id, size, source_size and target of its source, and the words taken of it, repeats
        counted."""
        n = F.greatest(F.lit(0), F.least("end", F.col("block") * BLOCK + F.col("words")) - F.col("begin"))
        joined = self._pieces().join(self.takes().select("source_no", "block", "words").hint("merge"), ["source_no", "block"], "left")
        each = joined.groupBy("row", "doc_id", "size", "source_no").agg(F.sum(F.when(F.col("words").isNull(), 0).otherwise(n)).alias("taken"))
        rows = [(s.index, s.size, s.target) for s in self.sources]
        of = self.docs.sparkSession.createDataFrame(rows, "source_no int, source_size long, target double")
        return each.join(broadcast_if_small(of), "source_no").select("doc_id", "size", "source_size", "target", "taken")

    def texts(self, docs: DataFrame) -> DataFrame:
        """The text of each block taken, words joined by one space: shard, slot, text. ``docs`` are the documents that
        were mixed."""
        common.small_text_batches(docs.sparkSession)
        whole = docs.select(F.col("doc_id").cast("long").alias("_id"), common.text_key().alias("_key"), F.col("text").alias("_text")).filter("_text IS NOT NULL").dropDuplicates(["_id", "_key"])
        of = self.docs.filter("size > 0").join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
        parts = of.select("source_no", "start", "_text").mapInArrow(common.trimmed(_cut_up), "source_no int, block long, place long, part string")
        joined = parts.join(self.takes(), ["source_no", "block"]).filter("place < words")
        words = F.slice(F.split("part", " "), F.lit(1), (F.col("words") - F.col("place")).cast("int"))
        held = F.collect_list(F.struct("place", F.array_join(words, " ").alias("part")))
        return joined.groupBy("shard", "slot").agg(F.array_join(F.transform(F.array_sort(held), lambda p: p["part"]), " ").alias("text"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _cut_up(batches: common.Batches) -> common.Batches:
    """A document's words by the blocks they are in, in one pass over its text."""
    names = ["source_no", "block", "place", "part"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        for source, start, text in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            words = (m[0] for m in _WORD.finditer(text))
            at = start
            while part := list(itertools.islice(words, BLOCK - at % BLOCK)):
                rows.append((source, at // BLOCK, at % BLOCK, " ".join(part)))
                at, held = at + len(part), held + len(rows[-1][3])
                if held > common.SLICE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _taking(sources: list[Source], shards: int, at_once: int, seed: int) -> Callable[[common.Batches], common.Batches]:
    names = ["shard", "slot", "source_no", "epoch", "block", "words"]

    def run(batches: common.Batches) -> common.Batches:
        takes = np.array([s.takes for s in sources], np.int64)
        for batch in batches:
            for nth in batch.column(0).to_pylist():
                for shard, first, counts in dealt(takes, shards, nth * at_once, min((nth + 1) * at_once, shards), seed):
                    parts = [(s.index, *s.block_of(np.arange(f, f + c))) for s, f, c in zip(sources, first, counts, strict=True) if c]
                    n = int(counts.sum())
                    if n:
                        number = np.concatenate([np.full(len(b), i, np.int32) for i, _, b, _ in parts])
                        columns = [np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2, 3)]
                        slot = permuted(np.arange(n), n, seed + shard)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(n, shard), slot, number, *columns)], names)

    return run


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: int = SEED) -> Mix:
    """The mix of ``docs(doc_id, text, source)``.

    A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none and are never
    taken. Sources by code point, null last, have the weights in turn. The order of a source's words goes by doc_id
    (null first) and text, so the mix depends on rows and seed, not on files or partitions; rows that are equal are
    interchangeable. An empty table gives an empty mix. More columns don't matter, whatever their names.
    """
    common.small_text_batches(docs.sparkSession)
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key().alias("text_key"), F.col("source").cast("string").alias("source"), _words("text").alias("size"), F.monotonically_increasing_id().alias("uid")))
    order = ["source", "doc_id", "text_key", "size", "uid"]
    placed = cut(sized.repartitionByRange(*order).sortWithinPartitions(*order).drop("uid"))
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    held = placed.withColumn("part", part).groupBy("part", "source").agg(F.sum("size").alias("size"))
    if held.select("source").distinct().limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    counts = sorted(((r.source is None, r.source or "", r.part, r.size) for r in held.collect()))
    sizes: dict[str | None, int] = {}
    starts = {}
    for unnamed, name, number, size in counts:
        source = None if unnamed else name
        starts[number, source] = sizes.get(source, 0)
        sizes[source] = sizes.get(source, 0) + size
    names = list(sizes)
    wanted = targets([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share, most)
    seeds = [int.from_bytes(hashlib.sha256(f"{seed}:{'' if s is None else 's' + s}".encode()).digest()[:7]) for s in names]
    sources = [Source(i, s, sizes[s], t, k) for i, (s, t, k) in enumerate(zip(names, wanted, seeds, strict=True))]
    numbers = {s: i for i, s in enumerate(names)}
    kinds = "doc_id long, text_key long, source string, size long, source_no int, start long"
    streams = placed.mapInArrow(_streamed(starts, numbers), kinds).withColumn("row", F.monotonically_increasing_id())
    return Mix(streams, sources, seed)
