"""Benchmark items inside documents: size-partitioned MinHash containment search, native throughout.

Items are partitioned by the size of their shingle set. A document that holds a share ``t`` of an item's
shingles misses at most (1 - t) of them, so of the item's smallest hashes, one more than that number are
enough for one to be found in every such document: that many MinHash values are an item's sketch, the
same number for all items of a size class. All shingles of all documents are looked up in the sketches;
the (document, item) pairs that meet are verified by exact containment of the item's shingles. An item of
fewer words than a shingle is one shingle of its own length; for each such length that occurs, documents are
looked up by their runs of that many words, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlight.llm import common
from kinlight.plans.lineage import broadcast_if_small, cut, is_small, join_spread

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: What separates words: all ASCII but letters and digits.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Sketch rows up to which the sketches are broadcast, and items with their shingles.
BROADCAST_SKETCHES = 500_000
BROADCAST_ITEMS = 10_000


def words_of(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def _shingles(words: str, k: int) -> Column:
    """Distinct k-word shingles, space-joined; of fewer words, the whole sequence."""
    places = F.when(F.size(words) > k, F.sequence(F.lit(1), F.size(words) - (k - 1))).when(F.size(words) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(words, i, k), " ")))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(hashes: str, k: int) -> Column:
    """A hash for each k-word shingle, from a column of the words' hashes. (An expression in place of the
    column would be computed again for each shingle.)"""
    places = F.when(F.size(hashes) > k, F.sequence(F.lit(0), F.size(hashes) - k)).when(F.size(hashes) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def sketches(benchmark: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Items as (item_id, shingles, n, width in words) and their sketches as (hash, item_id). Size classes double:
    1, 2-3, 4-7 and so on; a class's sketch size fits its largest items."""
    items = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("words")).filter((F.size("words") > 0) & F.col("item_id").isNotNull())
    items = items.select("item_id", "words", _word_hashes(F.col("words")).alias("word_hashes"))
    items = items.select("item_id", F.least(F.size("words"), F.lit(k)).alias("width"), _shingles("words", k).alias("shingles"), F.array_distinct(_shingle_hashes("word_hashes", k)).alias("hashes"))
    items = items.withColumn("n", F.size("shingles"))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    # misses of a member are at most n - ceil(t n) <= floor((1 - t) largest); one more must be found
    size = (F.floor((1 - threshold) * largest + 1e-9) + 1).cast("int")
    sketch = items.select("item_id", F.explode(F.slice(F.array_sort("hashes"), F.lit(1), size)).alias("hash"))
    return items.select("item_id", "shingles", "n", "width"), sketch.select("hash", "item_id").distinct()


def _runs(hashes: str, width: int) -> Column:
    """A hash for each run of ``width`` words; fewer words have none."""
    places = F.when(F.size(hashes) >= width, F.sequence(F.lit(0), F.size(hashes) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))


def find_contained(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE_WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold`` of the distinct ``k``-word
    shingles: (doc_id, item_id, n_shingles, n_found, containment), one row per pair.

    Words are lower-cased runs of letters and digits (all beyond ASCII count as letters); an item of fewer
    than ``k`` words is one shingle, its whole sequence, found wherever a document has these words in a row.
    Null texts are empty, and items without words are in no document. Rows without an id are in no pair.
    Repeated rows and repeated items give one pair, with the largest share. Empty tables give an empty
    result; other columns are ignored.

    No pair is missed: a document that holds the share has at least one hash of the sketch. Hashes of shingles
    only propose pairs; the shares are counted on the words. Documents are read twice and neither shuffled
    nor sent to Python where sketches and pairs are few, which is counted first; beyond that Spark shuffles.
    """
    items, sketch = sketches(benchmark, k, threshold)
    items, sketch = cut(items), cut(sketch)
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    hashed = named.select("doc_id", _word_hashes(words_of(F.col("text"))).alias("word_hashes"))
    widths = [r.width for r in items.select("width").distinct().collect()]  # 1 to k
    runs = F.concat(*[_runs("word_hashes", w) for w in sorted(widths)]) if widths else F.array().cast("array<bigint>")
    looked_up = hashed.select("doc_id", F.explode(runs).alias("hash"))
    if is_small(sketch, BROADCAST_SKETCHES):
        met = looked_up.join(F.broadcast(sketch), "hash")
    else:  # a frequent shingle is many tasks' work
        by_hash = sketch.groupBy("hash").agg(F.collect_set("item_id").alias("items"))
        met = join_spread(looked_up, by_hash, ["hash"], "doc_id", "inner").select("doc_id", F.explode("items").alias("item_id"))
    pairs = cut(met.select("doc_id", "item_id").distinct())
    both = named.join(broadcast_if_small(pairs.groupBy("doc_id").agg(F.collect_set("item_id").alias("items"))), "doc_id")
    spaced = both.select("doc_id", F.concat(F.lit(" "), F.array_join(words_of(F.col("text")), " "), F.lit(" ")).alias("spaced"), "items")
    candidates = spaced.select("doc_id", "spaced", F.explode("items").alias("item_id")).join(broadcast_if_small(items, BROADCAST_ITEMS), "item_id")
    inside = F.size(F.filter("shingles", lambda s: F.contains(F.col("spaced"), F.concat(F.lit(" "), s, F.lit(" ")))))
    counted = candidates.select("doc_id", "item_id", F.col("n").alias("n_shingles"), inside.alias("n_found"))
    best = counted.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_found") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_found")).alias("b"))
    shares = best.select("doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_found").cast("long").alias("n_found"), F.col("b.containment").alias("containment"))
    return shares.filter(F.col("containment") >= threshold)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in no pair of :func:`find_contained`, with all their columns, whatever
    their names. Rows without an id stay; of rows that share an id, all stay or none. An empty benchmark drops
    nothing, and an empty table gives an empty result."""
    leak = common.unused("leak", docs)
    leaks = cut(find_contained(docs, benchmark).select(F.col("doc_id").alias(leak)).distinct())
    return docs.join(broadcast_if_small(leaks), F.col("doc_id") == F.col(leak), "left_anti")
