"""A training corpus from raw documents: the stages in order, each over all that its predecessor kept."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.llm import jaccard_join, mixing, packing, suffix_dedup, toxicity  # noqa: E402
from tidemark.session import materialize  # noqa: E402


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes go; n_chars follows the text."""
    return suffix_dedup.without_repeats(docs, length_column="n_chars")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the target mixture and its order; every document stays at least once."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences of 2048 tokens."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Classifier, tokenizer and byte-level passages have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
