"""Derived views over the driver tables that the registered queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.catalog.registry import table


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message: conv_id, turn, role, content."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


def collect_messages(long: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Turn rows to one ``messages`` array per conversation, in turn order."""
    grouped = long.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, "role", "content"))).alias("_m"))
    return grouped.select(
        key, F.transform("_m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages")
    )


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collect_messages(turns(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def doc_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one-message conversations, for operators that take a training table."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("original_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
    )


def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as scored rollouts: prompt = user, reward = value, error = not stopped."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("rollout_id"),
        F.col("user_id").alias("prompt_id"),
        F.col("value").alias("reward"),
        F.when(F.col("event_type") == "error", "length").otherwise("stop").alias("finish_reason"),
        F.col("event_type").alias("verifier"),
        F.col("ts"),
        F.col("props"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as rated responses: prompt = part, response = (order, line), four aspects."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("prompt_id"),
        "l_orderkey",
        "l_linenumber",
        F.col("l_quantity").alias("a1"),
        F.col("l_extendedprice").alias("a2"),
        F.col("l_discount").alias("a3"),
        F.col("l_tax").alias("a4"),
    )
