"""The training-data pipeline: documents in, token files out, one stage after another.

Every stage takes the documents its predecessor kept, with all their columns, and its result is
written and read again before the next one begins.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from fieldmark.llm import decontaminate, language_id, mixing, odd_sketch, token_store
from fieldmark.llm.common import settings, small_batches, store


def in_small_batches(stage):
    """The stage with its batches of texts bounded; the settings stay, since its result is evaluated by who called it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in small_batches().items():
            spark.conf.set(name.replace("__", "."), value)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language; texts without letters go."""
    return language_id.with_language(docs)


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, similarity 0.8)."""
    return odd_sketch.one_of_each_group(docs)


@in_small_batches
def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@in_small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights; a document may be taken in part, or twice."""
    return mixing.mixed_documents(docs)


@in_small_batches
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, described per document from what they hold."""
    return token_store.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]
#: tokens and language models cannot be stated in SQL; tests/llm/test_pipeline.py checks the stages instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on what the one before kept; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with settings(spark, **small_batches()):  # every stage is stored here, so the session gets its own back
        for name, stage in STAGES:
            docs = store(stage(spark, docs, sf_dir), name)
    return docs
