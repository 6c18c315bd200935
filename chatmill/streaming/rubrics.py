"""Rubric buffer: one row per query with active, inactive and persistent rubrics.

A batch of new rubrics and score statistics is merged into the buffer table by query; on a stream the same
merge runs in foreachBatch and writes version ``batch id + 1`` of the buffer, so a repeated batch starts
from the same version and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.schema import RUBRIC

RUBRICS = f"array<{RUBRIC.simpleString()}>"
BUFFER_SCHEMA = f"query string, active {RUBRICS}, inactive {RUBRICS}, persistent {RUBRICS}"


def _empty() -> Column:
    return F.array().cast(RUBRICS)


def weighted(rubrics: str, weight: float) -> Column:
    """Rubrics (title, description) with the given weight."""
    each = F.transform(F.col(rubrics), lambda r: F.struct(r["title"].alias("title"), r["description"].alias("description"), F.lit(weight).alias("weight")))
    return F.coalesce(each, _empty())


def add_rubrics(buffer: DataFrame, new: DataFrame, order_by: str = "position") -> DataFrame:
    """Append the new positive (+1) and negative (−1) rubrics of a batch, once per query: the first answer
    of a query that brings any. ``new``: query, position, positive, negative; both null when generation failed."""
    valid = new.filter("positive is not null or negative is not null")
    first = valid.groupBy("query").agg(F.min_by(F.struct("positive", "negative"), order_by).alias("n"))
    first = first.select("query", F.col("n.positive").alias("positive"), F.col("n.negative").alias("negative"))
    j = buffer.join(first, "query", "left")
    return j.withColumn("active", F.concat("active", weighted("positive", 1.0), weighted("negative", -1.0))).drop("positive", "negative")


def prune_rubrics(buffer: DataFrame, stats: DataFrame, max_active: int, key: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Deactivate active rubrics whose scores never vary; over the cap keep those with the highest standard
    deviation and all that were not scored. ``stats``: query, key, std. ``key`` maps (query, rubric) to the
    statistics key, by default ``query::title``."""
    make = key or (lambda q, r: F.concat(q, F.lit("::"), F.coalesce(r["title"], F.lit(""))))
    per_query = stats.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("key", "std"))).alias("_s"))
    j = buffer.join(per_query, "query", "left")
    std = lambda r: F.try_element_at(F.coalesce(F.col("_s"), F.create_map().cast("map<string,double>")), make(F.col("query"), r))
    flat = lambda r: F.coalesce(std(r) == 0, F.lit(False))
    j = j.withColumn("_flat", F.filter("active", flat)).withColumn("active", F.filter("active", lambda r: ~flat(r)))
    # the lowest deviation that is still kept; among equals earlier rubrics win
    ranked = F.sort_array(F.filter(F.transform("active", lambda r, i: F.struct((-std(r)).alias("s"), i.alias("i"), make(F.col("query"), r).alias("k"))), lambda x: x["s"].isNotNull()))
    j = j.withColumn("_keep", F.transform(F.slice(ranked, 1, max_active), lambda x: x["k"]))
    over = F.size("active") > max_active
    keep = lambda r: std(r).isNull() | F.array_contains(F.col("_keep"), make(F.col("query"), r))
    dropped = F.when(over, F.filter("active", lambda r: ~keep(r))).otherwise(_empty())
    j = j.withColumn("_dropped", dropped).withColumn("active", F.when(over, F.filter("active", keep)).otherwise(F.col("active")))
    return j.withColumn("inactive", F.concat("inactive", "_flat", "_dropped")).drop("_s", "_flat", "_keep", "_dropped")


def ground_truth(answers: DataFrame, buffer: DataFrame) -> DataFrame:
    """Rubrics to score an answer with, and their kinds: persistent plus active ones of its query's buffer;
    without a buffer the answer's own rubrics plus its new ones; unchanged when generation failed."""
    b = buffer.select("query", F.col("persistent").alias("_p"), F.col("active").alias("_a"), F.lit(True).alias("_b"))
    j = answers.join(b, "query", "left")
    failed = F.col("positive").isNull() & F.col("negative").isNull()
    fresh = F.concat(weighted("positive", 1.0), weighted("negative", -1.0))
    base = F.when(F.col("_b"), F.col("_p")).otherwise(F.col("rubrics"))
    extra = F.when(F.col("_b"), F.col("_a")).otherwise(fresh)
    kinds = F.concat(F.transform(base, lambda _: F.lit("persistent")), F.transform(extra, lambda _: F.lit("evolving")))
    own = F.transform("rubrics", lambda _: F.lit("persistent"))
    return j.withColumns({"rubrics": F.when(failed, F.col("rubrics")).otherwise(F.concat(base, extra)), "rubric_types": F.when(failed, own).otherwise(kinds)}).drop("_p", "_a", "_b")


def buffer_sink(path: str, max_active: int) -> Callable[[DataFrame, int], None]:
    """foreachBatch function over rows (query, position, positive, negative, key, std): version v of the
    buffer is read from ``path/v=<batch id>`` and the next version written."""

    def sink(batch: DataFrame, step: int) -> None:
        buffer = batch.sparkSession.read.schema(BUFFER_SCHEMA).parquet(f"{path}/v={step}")
        stats = batch.filter("key is not null").groupBy("query", "key").agg(F.max("std").alias("std"))
        prune_rubrics(add_rubrics(buffer, batch), stats, max_active).write.mode("overwrite").parquet(f"{path}/v={step + 1}")

    return sink
