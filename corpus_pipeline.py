"""The corpus pipeline: quality, exact duplicates, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as parquet and read again as the
next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinlight.llm import common, quality
from kinlight.llm.best_fit import pack
from kinlight.llm.decontamination import drop_contaminated
from kinlight.llm.exact_dedup import drop_exact_duplicates
from kinlight.llm.simhash import ALIKE, drop_near_duplicates
from kinlight.plans.lineage import checkpoint_dir, cut, remove_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of ``docs``, predicts as good. Null and empty texts
    are scored like any other; repeated rows stay or go together. Without labels nothing is learnt and all rows
    stay; an empty table stays empty."""
    return quality.drop_low_quality(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest id; rows that repeat an id and a text
    leave one. Null and empty texts are one group; rows without an id come after all others. An empty table
    stays empty."""
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest id. Texts link whose SimHash
    fingerprints are near, and whose sets of 5-word shingles have a Jaccard share of 0.8 or more. Texts without words
    (null, empty) are near copies of each other; repeated rows leave one. An empty table stays empty."""
    return drop_near_duplicates(docs, least=ALIKE)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none, and rows without an id stay; repeated
    rows stay or go together. An empty benchmark drops nothing, and an empty table stays empty."""
    return drop_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of 4,096 tokens. Null and empty texts are one end
    token; repeated rows are packed as often as they come. An empty table gives no piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Stages that SQL can't express (the classifier, SimHash, the tokenizer) make the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list[tuple[str, Stage]] = STAGES) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared checkpoint folder and read again. What the
    stages wrote is deleted when the last one's rows are checkpointed, or if one fails."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    try:
        for name, stage in stages[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return cut(stages[-1][1](spark, docs, sf_dir))
    finally:
        remove_folder(spark, folder)
