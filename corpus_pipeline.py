"""Documents to a clean, mixed and sharded corpus: five stages, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickweave.llm import decontamination, language, mixing, sharding, similarity
from tickweave.llm.common import bounded_batches, stored, table

SHARDS = 24


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept; the others go."""
    bounded_batches(spark)
    return language.accepted_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard 0.8 of five-word shingles stays."""
    bounded_batches(spark)
    return similarity.keep_one_per_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def target_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that token shares of source, language and topic meet their targets."""
    return mixing.sampled_mixture(docs)


def into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with their shard of near equal bytes, tokens and rows."""
    bounded_batches(spark)
    _, assign = sharding.sharded(docs, SHARDS)
    return assign(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("mixture", target_mixture),
    ("sharding", into_shards),
]

# Kneser-Ney models and graph components have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
