"""From raw documents to training sequences: quality filter, near-dedup, PII removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``, which is what the stage before
kept, written as Parquet and read again. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, stored, table
from . import likeness, packing, pii, quality
from .registry import vocabulary

#: Documents that score below this are rejected.
THRESHOLD = 0.7


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier, fitted on the labelled ones among them, does not reject."""
    forest = quality.learn(docs, table(prepare(spark), sf_dir, "labels"), held=2, parts=4)
    return quality.accepted(docs, forest, THRESHOLD)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (five words, similarity 0.8), the one with the smallest id.

    The SimHash join and MinHash bands propose groups, exact similarities decide.
    """
    prepare(spark)
    return likeness.keep_one(docs, least=0.8, shingle=5, budget=4)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind in brackets."""
    prepare(spark)
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack: a row for each piece."""
    prepare(spark)
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=1024, end_id=2)


STAGES = [("quality", quality_stage), ("near_dedup", dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: SQL cannot express the learned and packed stages; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
