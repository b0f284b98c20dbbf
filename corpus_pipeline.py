"""A cleaning pipeline over ``documents``.

Each stage reads what its predecessor kept, written as Parquet and read again, and returns the columns of ``documents``; the last
returns each kept document's tokens. Nulls, empty texts and repeated rows are treated as the stages' operators define."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from floodreach.llm import bpe, decontaminate, quality_rules, secrets, simhash
from floodreach.session import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality), ("simhash_dedup", near_duplicates), ("decontaminate", decontamination), ("secrets", secret_scan), ("bpe_tokens", tokens)]

# Fingerprint components and Markov models have no SQL counterpart
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
