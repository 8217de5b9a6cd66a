"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents with
benchmark items go, sources are mixed to their weights, and token files are written and indexed.

Each stage takes the rows that the stage before it kept. All but the last return the documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tokentally.llm import decontamination, mixing, near_duplicates, token_files, toxicity
from tokentally.llm.registry import table
from tokentally.sources.shared import written

#: SQL cannot express the stages; tests compare them with plain versions.
ORACLE_SQL = None
#: Near duplicates share 0.8 of their shingles of five words or more (op5_near_duplicates links from 0.85 on).
#: At exactly 0.8, 26 errors lose 1 pair in 23,000; at 0.85, the operator's 21 lose 1 in 10,500.
NEAR = near_duplicates.Rule(similar=80, distance=26)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.without_near_duplicates(docs, NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.tokens_through_files(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("token_files", token_index),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage keeps is written for the next one."""
    docs = table(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = written(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
