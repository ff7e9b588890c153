"""From raw documents to token ids: the stages of corpus preparation in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urlrisk.llm import bpe, decontam, grades, neardup, passages
from urlrisk.session import materialize


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of low quality go; the classifier learns from the labels of this corpus."""
    return grades.only_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return neardup.without_copies(docs, words=5, percent=80)


def no_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the first document that has them and are cut from the others."""
    return passages.without_passages(docs)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as counts and digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", one_of_each_group),
    ("substring dedup", no_repeated_passages),
    ("benchmark decontamination", no_benchmark_items),
    ("byte-level BPE", encoded),
]
#: The stages cannot be said in SQL; tests/llm holds the exact runs of passages, pairs of copies and benchmark items
#: against brute force, and quality by its labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
