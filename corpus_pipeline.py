"""The training-data pipeline: documents to packed token sequences, stage by stage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import decontaminate, exact_dedup, language, packing, simhash
from tidepanel.llm.common import table
from tidepanel.llm.queries import tokenizer_path
from tidepanel.session import small_batches, stage

Step = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to one of the languages they can be learned from."""
    return language.keep_identified(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for white space) the longest stays."""
    return exact_dedup.drop_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by their fingerprints the one with the smallest id stays."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go as a whole."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), max_coverage=0.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


def in_small_batches(step: Step) -> Step:
    """Every step passes whole texts through Python workers, which stay from step to step."""

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return step(spark, docs, sf_dir)

    return run_step


STAGES = [
    ("language", in_small_batches(known_language)),
    ("exact_dedup", in_small_batches(without_copies)),
    ("near_dedup", in_small_batches(without_near_copies)),
    ("decontamination", in_small_batches(without_benchmark)),
    ("packing", in_small_batches(packed)),
]

# clustering, fingerprints and tokenizers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each on what its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
