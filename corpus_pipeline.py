"""A corpus pipeline: five stages, each an operator of tidemill.llm on the rows its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import drop_leaks
from tidemill.llm.language_id import keep_known_languages
from tidemill.llm.ngram_join import keep_one_of_each
from tidemill.llm.packing import best_fit_packing
from tidemill.llm.substring_dedup import without_repeats
from tidemill.llm.text import saved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose letters no mixture of the languages explains better than chance, go."""
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates stays."""
    return keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 35-word windows go, and documents of nothing else."""
    return without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in bins of 2048 words."""
    return best_fit_packing(docs)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontaminate", benchmark_leaks),
    ("best_fit_packing", packed),
]

#: Expectation-maximisation and best-fit search are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, from the documents table; each is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
