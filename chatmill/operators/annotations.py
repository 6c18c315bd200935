"""Acceptance, win rates and agreement over pairwise human annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatmill.operators.ordering import first_per_key


def latest_per_evaluator(df: DataFrame, instance: str = "instance_id", evaluator: str = "evaluator", ts: str = "timestamp", tie: str | None = None) -> DataFrame:
    """Keep the latest record of an evaluator on an instance and number the kept ones by time (``nth``).
    Only the first two annotations of an instance matter downstream, so only they are numbered."""
    order = [ts] + ([tie] if tie else [])
    kept = first_per_key(df, [instance, evaluator], order, keep="last")
    w = Window.partitionBy(instance).orderBy(*order, evaluator)
    return kept.withColumn("nth", F.row_number().over(w)).filter("nth <= 2")


def first_two(kept: DataFrame, instance: str, values: dict[str, str]) -> DataFrame:
    """One row per instance: the first and second value of each column."""
    aggs = []
    for name, column in values.items():
        for k in (1, 2):
            aggs.append(F.max(F.when(F.col("nth") == k, F.col(column))).alias(f"{name}{k}"))
    return kept.groupBy(instance).agg(F.max("nth").alias("n"), *aggs)


def acceptance(kept: DataFrame, instance: str = "instance_id", a: str = "completion_a_is_acceptable", b: str = "completion_b_is_acceptable") -> DataFrame:
    """Acceptance of both models by the first annotation, and agreement of the first two."""
    t = first_two(kept, instance, {"a": a, "b": b})
    multi = F.col("n") > 1
    same = lambda m: F.avg(F.when(multi, (F.col(f"{m}1") == F.col(f"{m}2")).cast("double")))
    return t.agg(
        F.count("*").alias("instances"),
        F.avg((F.col("a1") == "yes").cast("double")).alias("a_acceptance"),
        F.avg((F.col("b1") == "yes").cast("double")).alias("b_acceptance"),
        F.count_if(multi).alias("multi_annotated"),
        same("a").alias("a_agreement"),
        same("b").alias("b_agreement"),
        ((same("a") + same("b")) / 2).alias("acceptance_agreement"),
    )


def comparison(kept: DataFrame, instance: str = "instance_id", preference: str = "preference") -> DataFrame:
    """Shares of the first preference, wins per side, strict and relaxed agreement of the first two."""
    side = F.when(F.col(preference).startswith("a-"), "a").when(F.col(preference).startswith("b-"), "b").otherwise("tie")
    t = first_two(kept.withColumn("_side", side), instance, {"p": preference, "s": "_side"})
    share = lambda cond: F.avg(cond.cast("double"))
    multi = F.col("n") > 1
    agree = (F.col("s1") == F.col("s2")).cast("double")
    one_tie = ((F.col("s1") == "tie") | (F.col("s2") == "tie")).cast("double")
    return t.agg(
        share(F.col("p1") == "a-is-better").alias("a_clearly_better"),
        share(F.col("p1") == "a-is-slightly-better").alias("a_slightly_better"),
        share(F.col("p1") == "b-is-better").alias("b_clearly_better"),
        share(F.col("p1") == "b-is-slightly-better").alias("b_slightly_better"),
        share(F.col("p1") == "tie").alias("tie"),
        share(F.col("s1") == "a").alias("a_wins"),
        share(F.col("s1") == "b").alias("b_wins"),
        F.count_if(multi).alias("multi_annotated"),
        F.avg(F.when(multi, agree)).alias("agreement"),
        F.avg(F.when(multi, F.when(agree == 1, 1.0).otherwise(0.5 * one_tie))).alias("relaxed_agreement"),
    )
