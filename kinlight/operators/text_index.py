"""Substring search by an index of trigrams.

A folder holds a row for each distinct trigram of each text, partitioned by a hash of the trigram and sorted by it, and
how many texts have each. A search looks its fragment's trigrams up in the counts, takes the rarest few, reads their
lists alone, and intersects them; texts that have all are candidates, and the fragment itself decides. Fragments under
three characters, and those whose rarest trigram most texts have, are looked for by a scan.

Texts are added in batches, each a folder of its own: postings first, then counts, whose success mark makes the batch
count. A batch that was stopped in between is written again whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.functions.text import contains_text, fold_case
from kinlight.plans.lineage import broadcast_if_small

#: Partitions of the postings, by a hash of the trigram.
PARTS = 64
#: Lists that are intersected at most; more narrow the candidates little and cost a read each.
LISTS = 4
#: Share of the texts above which a scan is cheaper than a list.
SCAN_SHARE = 0.25
POSTINGS = "gram string, id long, part int"
COUNTS = "gram string, n long"


def trigrams(text: Column | str) -> Column:
    """The distinct runs of three characters of a text, ignoring ASCII case; none of a null or shorter one."""
    folded = fold_case(text)
    last = F.length(folded) - 2
    runs = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(folded, i, F.lit(3)))
    return F.when(last >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _part(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


class TextIndex:
    """Trigrams of texts by id, under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> int:
        """How many batches count."""
        n = 0
        while self._files.exists(self._path(f"{self.folder}/counts/{n + 1}/_SUCCESS")):
            n += 1
        return n

    def add(self, table: DataFrame, id_col: str, text_col: str) -> None:
        """Add a batch of new texts. Rows without an id or a text are left out. Ids may repeat; a changed text under a
        known id is added beside the old one, whose lists then only propose."""
        n = self.batches() + 1
        rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
        grams = rows.select("id", F.explode(trigrams("text")).alias("gram")).withColumn("part", _part(F.col("gram")))
        # ranges of (part, gram, id): a trigram that most texts have is dealt to many tasks
        grams.repartitionByRange("part", "gram", "id").sortWithinPartitions("part", "gram", "id").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/postings/batch={n}")
        written = self.spark.read.schema(POSTINGS).parquet(f"{self.folder}/postings/batch={n}")
        counts = written.groupBy("gram").agg(F.count("*").alias("n"))
        # the total stands under a name that no trigram has
        total = rows.agg(F.lit("").alias("gram"), F.count("*").alias("n"))
        counts.unionByName(total).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.folder}/counts/{n}")

    def _counts(self, grams: list[str]) -> dict[str, int]:
        read = self.spark.read.schema(COUNTS).parquet(*[f"{self.folder}/counts/{i}" for i in range(1, self.batches() + 1)])
        return {r.gram: r.n for r in read.filter(F.col("gram").isin(grams)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}

    def postings(self, grams: list[str]) -> DataFrame:
        """(gram, id) of some trigrams; other partitions aren't read."""
        parts = [r.part for r in self.spark.createDataFrame([(g,) for g in grams], "gram string").select(_part(F.col("gram")).alias("part")).distinct().collect()]
        read = self.spark.read.schema(POSTINGS).option("basePath", f"{self.folder}/postings")
        rows = read.parquet(*[f"{self.folder}/postings/batch={i}" for i in range(1, self.batches() + 1)])
        return rows.filter(F.col("part").isin(parts) & F.col("gram").isin(grams)).select("gram", "id")

    def candidates(self, fragment: str) -> DataFrame | None:
        """Ids of texts that may hold the fragment, each once, and surely those of all that do; None if a scan is due."""
        made = self.spark.range(1).select(trigrams(F.lit(fragment)).alias("grams")).first().grams
        if not made or not self.batches():
            return None
        counts = self._counts([*made, ""])
        rarest = sorted(made, key=lambda g: (counts.get(g, 0), g))[:LISTS]
        if counts.get(rarest[0], 0) > SCAN_SHARE * counts[""]:
            return None
        rarest = [g for g in rarest if counts.get(g, 0) <= SCAN_SHARE * counts[""]]
        return self.postings(rarest).groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(rarest)).select("id")

    def search(self, table: DataFrame, id_col: str, text_col: str, fragment: str) -> DataFrame:
        """The rows of ``table`` whose text holds the fragment literally, ignoring ASCII case: those of a scan, if the
        index has all texts of ``table``. A blank fragment occurs nowhere."""
        found = table if not fragment.strip() else self.narrowed(table, id_col, fragment)
        return found.filter(contains_text(text_col, fragment))

    def narrowed(self, table: DataFrame, id_col: str, fragment: str) -> DataFrame:
        """The rows of ``table`` that are candidates for the fragment."""
        ids = self.candidates(fragment)
        if ids is None:
            return table
        key = "_candidate"
        while key in table.columns:
            key += "_"
        return table.join(broadcast_if_small(ids.withColumnRenamed("id", key)), F.col(id_col).cast("long") == F.col(key), "left_semi")
