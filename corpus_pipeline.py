"""A training-corpus pipeline: five operators, each working on all that the one before it kept."""

from __future__ import annotations

import public_tokenizers
from lorebase.llm import byte_bpe, exact, mixing, quality, simhash
from lorebase.llm.common import settle, table
from lorebase.llm.queries import TARGETS, labelled_domains
from pyspark.sql import DataFrame, SparkSession


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of smallest doc_id stays."""
    return exact.keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id stays."""
    return simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated as their fitted rates ask, so that languages come near their target weights."""
    return mixing.repeat_documents(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token count and digests of ids and decoded bytes of each document."""
    return byte_bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mixing", mixture),
    ("byte-level BPE", encoded),
]

#: The classifiers and SimHash are not expressible in SQL; tests/llm compares stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
