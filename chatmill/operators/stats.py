"""Data set statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.arrays import let

# Fixed values. Length thresholds reported per data set.
THRESHOLDS = [512, 768, 1024, 1536, 2048, 4096]


def describe(c: Column, name: str, exact: bool = True) -> list[Column]:
    """count, mean, sample std, min, quartiles, max. Exact quartiles keep one counter per distinct
    value, which suits lengths; for measures with unbounded distinct values use ``exact=False``."""
    q = (lambda p: F.percentile(c, F.lit(p))) if exact else (lambda p: F.percentile_approx(c, p, 10000).cast("double"))
    return [
        F.count(c).alias(f"{name}_count"),
        F.avg(c).alias(f"{name}_mean"),
        F.stddev_samp(c).alias(f"{name}_std"),
        F.min(c).alias(f"{name}_min"),
        q(0.25).alias(f"{name}_p25"),
        q(0.5).alias(f"{name}_p50"),
        q(0.75).alias(f"{name}_p75"),
        F.max(c).alias(f"{name}_max"),
    ]


def over_thresholds(c: Column, thresholds=THRESHOLDS) -> list[Column]:
    return [F.count_if(c > t).alias(f"n_gt_{t}") for t in thresholds]


def instance_lengths(long: DataFrame, key: str, length: Column, by: list[str] = ()) -> DataFrame:
    """Per conversation: turns and total length, system messages left out. From message rows."""
    spoken = F.col("role") != "system"
    return long.groupBy(*by, key).agg(
        F.count_if(spoken).alias("turns"), F.coalesce(F.sum(F.when(F.col("role").isin("user", "assistant"), length)), F.lit(0)).alias("total_length")
    )


def message_stats(long: DataFrame, key: str, length: Column, by: list[str] = ()) -> DataFrame:
    """Turns, message and instance length summaries per data set, from message rows."""
    inst = instance_lengths(long, key, length, by)
    per_message = long.groupBy(*by).agg(
        *describe(F.when(F.col("role") == "user", length), "user"), *describe(F.when(F.col("role") == "assistant", length), "assistant")
    )
    per_instance = inst.groupBy(*by).agg(
        F.count("*").alias("num_instances"), *describe(F.col("turns"), "turns"), *describe(F.col("total_length"), "total"), *over_thresholds(F.col("total_length"))
    )
    if by:
        return per_instance.join(per_message, list(by))
    row = per_message.select(F.struct("*").alias("m")).scalar()  # a single row
    return per_instance.withColumn("_m", row).select("*", "_m.*").drop("_m")


def prompt_completion_stats(df: DataFrame, prompt: Column, completion: Column, by: list[str] = ()) -> DataFrame:
    total = prompt + completion
    return df.groupBy(*by).agg(
        F.count("*").alias("num_instances"), *describe(prompt, "prompt"), *describe(completion, "completion"), *describe(total, "total"), *over_thresholds(total)
    )


def stats_table(stats: DataFrame, name: str, thresholds=(512, 2048)) -> DataFrame:
    """Averages and share over thresholds per data set, sorted by name."""
    share = [(100.0 * F.col(f"n_gt_{t}") / F.col("num_instances")).alias(f"pct_gt_{t}") for t in thresholds]
    means = [F.col(c) for c in stats.columns if c.endswith("_mean")]
    return stats.select(name, "num_instances", *means, *share).orderBy(name)


def mix_stats(final: DataFrame, sizes: DataFrame, source: str = "source", tokenised: bool = True) -> DataFrame:
    """Per source: initial, final, filtered, amount, original size, upsampling, tokens."""
    aggs = [F.count("*").alias("final_instances")]
    if tokenised:
        aggs += [
            F.sum(F.size("input_ids")).cast("long").alias("total_tokens"),
            F.sum(F.size(F.filter("labels", lambda x: x != -100))).cast("long").alias("trainable_tokens"),
        ]
    per = final.groupBy(source).agg(*aggs)
    out = sizes.join(per, source, "left").na.fill(0, [c for c in per.columns if c != source])
    out = out.withColumn("instances_filtered", F.col("initial_instances") - F.col("final_instances"))
    if tokenised:
        out = out.withColumn("avg_tokens_per_instance", F.when(F.col("final_instances") > 0, F.col("total_tokens") / F.col("final_instances")).otherwise(F.lit(0.0)))
    return out


def output_stats(df: DataFrame, source: str, tokens: Column, trainable: Column) -> DataFrame:
    """Per source and overall (source null): rows, tokens, trainable tokens, rows without a label,
    shares of tokens and rows."""
    per = df.select(source, tokens.cast("long").alias("t"), trainable.cast("long").alias("l")).rollup(source).agg(
        F.count("*").alias("instances"), F.sum("t").alias("tokens"), F.sum("l").alias("trainable_tokens"), F.count_if(F.col("l") == 0).alias("no_label")
    )
    most = lambda c: per.agg(F.max(c).alias("m")).scalar()  # the grand-total row holds the maximum
    return per.select(
        source, "instances", "tokens", "trainable_tokens", "no_label",
        (100.0 * F.col("tokens") / most("tokens")).alias("pct_tokens"), (100.0 * F.col("instances") / most("instances")).alias("pct_instances"),
    )


def bin_number(value: Column, edges: list[float]) -> Column:
    """0-based bin of half-open bins; the last bin includes its right edge; null outside."""
    n = len(edges) - 1
    inner = F.lit(0)
    for e in edges[1:-1]:
        inner = inner + (value >= e).cast("int")
    return F.when((value >= edges[0]) & (value <= edges[n]), inner)


def linear_edges(low: float, high: float, n: int = 24) -> list[float]:
    return [low + (high - low) * i / n for i in range(n + 1)]


def log_edges(low: float, high: float, n: int = 24) -> list[float]:
    return [low * (high / low) ** (i / n) for i in range(n + 1)]


def length_histogram(df: DataFrame, category: str, value: Column, edges: list[float], min_count: int = 0) -> DataFrame:
    """Counts per category and bin; categories under ``min_count`` rows fold into Other. One aggregate
    by (category, bin), then a second over its few rows."""
    cells = df.groupBy(F.col(category).alias("category"), bin_number(value, edges).alias("bin")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("category").agg(F.sum("n").alias("_size"))
    folded = cells.join(sizes, "category").withColumn("category", F.when(F.col("_size") >= min_count, F.col("category")).otherwise("Other"))
    return folded.filter("bin is not null").groupBy("category", "bin").agg(F.sum("n").alias("n"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


def seq_len_summary(df: DataFrame, length: str) -> DataFrame:
    return df.agg(F.min(length).alias("min"), F.max(length).alias("max"), F.avg(length).alias("mean"), F.percentile(F.col(length), F.lit(0.5)).alias("median"))


def token_usage_cost(df: DataFrame, prices: dict[str, tuple[float, float]], model: str = "model", prompt: str = "prompt_tokens", completion: str = "completion_tokens") -> DataFrame:
    """Token totals and cost per model, prices per million tokens as (input, output)."""
    per = df.groupBy(model).agg(F.sum(prompt).alias("prompt_tokens"), F.sum(completion).alias("completion_tokens"))
    price = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))]), F.col(model)), F.lit(0.0))
    return per.withColumn("cost", (F.col("prompt_tokens") * price(0) + F.col("completion_tokens") * price(1)) / 1e6)


def eval_summary(results: DataFrame, tasks: list[tuple[str, str, bool]], json: str = "metrics", task: str = "task", model: str = "model") -> DataFrame:
    """One row per model, one column per task in order: the task's metric path out of a JSON document,
    0–100 metrics rescaled, four decimals. ``tasks``: (task, JSON path, is_percentage)."""
    value = None
    for name, path, pct in tasks:
        v = F.get_json_object(json, path).try_cast("double")
        v = v / 100 if pct else v
        value = F.when(F.col(task) == name, v) if value is None else value.when(F.col(task) == name, v)
    return results.withColumn("_v", F.round(value, 4)).groupBy(model).pivot(task, [t[0] for t in tasks]).agg(F.first("_v", ignorenulls=True))


def distinct_tokens(tokens: Column) -> Column:
    return let(tokens, lambda t: F.size(F.array_distinct(t)))
