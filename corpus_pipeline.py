"""A training corpus from raw documents: quality rules, near duplicates, benchmark leaks, mixture, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import decontaminate, jaccard, mixing, planes, repetition
from tideline.llm.queries import MIX, domains, table, tokenizer_file
from tideline.session import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that domain token totals meet their target shares; none is lost."""
    return mixing.mix(docs, domains(table(spark, sf_dir, "labels")), MIX)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order, and what they hold of each document."""
    return planes.encode_table(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("mixture", mixture), ("token files", token_files)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
