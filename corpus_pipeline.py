"""The corpus pipeline: toxicity, near duplicates, benchmark contamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``; the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatmill.llm import decontamination, mixing, near_duplicates, sharding, toxicity
from chatmill.llm.common import table
from chatmill.session import materialise

SHARDS = 40
ORACLE_SQL = None  # fitted scores and seeded draws: see tests/llm


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of being toxic is 0.7 or more; learns from all labelled documents."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: shingles of five words, similarity 0.8."""
    return near_duplicates.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a 13-word window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents until the sources have their target sizes."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals the rows to shards of equal size in uniformly random order."""
    return sharding.shard(docs, SHARDS, settled=True)  # a table just read from its files


STAGES = [("toxicity", clean), ("near_duplicates", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
