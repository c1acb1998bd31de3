"""A corpus from ``documents``: good, without copies, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of docs. A stage's rows are written as Parquet in the shared folder and read from
there by the next one, so a lost executor costs a part of one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.llm import common, exact_dedup, mixing, near_dedup, quality, sentence_pieces

#: The trees, the hash join of signatures and Viterbi paths have no SQL form; of the stages
#: tests/llm holds near_dedup's kept ids against a plain version, the others' are not checked.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold."""
    return quality.keep_good(docs, quality.learn(docs, common.table(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near copies, at a similarity of 0.8 (op4's query
    has a contract of its own, 0.85)."""
    return near_dedup.drop_near_copies(docs, percent=80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as its source's target weight asks."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's pieces, and whether they decode to its text."""
    return sentence_pieces.encode(docs, sentence_pieces.model_path())


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mixed_sources),
    ("sentence_pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    out = STAGES[-1][1](spark, docs, sf_dir)
    return common.written(out.withColumn("ids_crc32", F.crc32(F.concat_ws(",", "ids").cast("binary"))).drop("ids"), "stage-pieces")
