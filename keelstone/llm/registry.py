"""The queries opN_<name>: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; KEELSTONE_TOKENIZERS names another folder."""
    folder = os.environ.get("KEELSTONE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe_encode

    return bpe_encode(table(prepare(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), digests=True)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(prepare(spark), sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .counts import token_counts

    return token_counts(table(prepare(spark), sf_dir, "documents"), vocabulary("word_bpe_49k.json"), limit=2048)


def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(table(prepare(spark), sf_dir, "documents"), held=1, parts=5)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(prepare(spark), sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), capacity=1024, end_id=2)


def op6_cws(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sampling import edited_likeness

    return edited_likeness(table(prepare(spark), sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_packages, write_packages

    found = read_packages(write_packages(table(prepare(spark), sf_dir, "pages")), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(table(prepare(spark), sf_dir, "documents"), budget=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, score

    docs = table(prepare(spark), sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels"), held=2, parts=4), held=2, parts=4, threshold=0.7)


def op10_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .flac import flac_columns

    return flac_columns(table(prepare(spark), sf_dir, "documents"), digests=True)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_encode": op1_bpe_encode,
    "op2_pii": op2_pii,
    "op3_token_counts": op3_token_counts,
    "op4_katz": op4_katz,
    "op5_pack": op5_pack,
    "op6_cws": op6_cws,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_flac": op10_flac,
    "pipeline": pipeline,
}

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND f IS DISTINCT FROM page_id THEN f END AS refers_to
        FROM m""",
}
