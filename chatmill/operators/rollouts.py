"""Group statistics, advantages and metrics over scored rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.operators.ordering import join_stats, segmented_lists


def group_reward_stats(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Per prompt: count, mean, population std, first/min/max reward."""
    return df.groupBy(prompt).agg(
        F.count("*").alias("n"),
        F.avg(reward).alias("mean_reward"),
        F.stddev_pop(reward).alias("std_reward"),
        F.min(reward).alias("min_reward"),
        F.max(reward).alias("max_reward"),
    )


def with_group_stats(df: DataFrame, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    return join_stats(df, group_reward_stats(df, prompt, reward), prompt)


def advantage(mode: str = "standard", reward: str = "reward") -> Column:
    centred = F.col(reward) - F.col("mean_reward")
    if mode == "standard":
        return centred / (F.col("std_reward") + F.lit(1e-8))
    if mode == "centered":
        return centred
    raise ValueError(f"unknown advantage mode {mode!r}")


def grpo_advantage(df: DataFrame, mode: str = "standard", prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Add group-relative ``advantage``. Statistics are aggregated first and joined back, so a prompt
    with very many rollouts is never one window partition."""
    stats = with_group_stats(df, prompt, reward)
    return stats.withColumn("advantage", advantage(mode, reward)).select(*df.columns, "mean_reward", "std_reward", "advantage")


def zero_std(max_score: float | None = None) -> Column:
    """Class of a group whose rewards are all equal: zero, solved or other; null when they differ.
    Equality is min = max, which rounding in the variance cannot blur."""
    top = F.lit(float("inf") if max_score is None else max_score)
    low = F.col("min_reward")
    return F.when(low == F.col("max_reward"), F.when(low == 0, "zero").when(low == top, "solved").otherwise("other"))


def zero_std_filter(df: DataFrame, max_score: float | None = None, prompt: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Rollouts of prompts whose rewards differ."""
    varied = group_reward_stats(df, prompt, reward).filter(zero_std(max_score).isNull())
    return join_stats(df, varied.select(prompt), prompt)


def annotate_passrate(prompts: DataFrame, scores: DataFrame, key: str, score: str) -> DataFrame:
    """Per prompt total_rollouts, total_correct and passrate; zeros where there is no rollout."""
    rates = scores.groupBy(key).agg(F.count("*").alias("total_rollouts"), F.avg(score).alias("passrate"))
    zero = F.lit(0).cast("long")
    return prompts.join(rates, key, "left").withColumns(
        {
            "total_rollouts": F.coalesce("total_rollouts", zero),
            "total_correct": F.coalesce(F.round(F.col("passrate") * F.col("total_rollouts")).cast("long"), zero),
            "passrate": F.coalesce("passrate", F.lit(0.0)),
        }
    )


def batch_statistics(df: DataFrame, max_score: float, prompt: str = "prompt_id", reward: str = "reward", no_resample_rate: float | None = None) -> DataFrame:
    """One row: prompts, share solved, filtered prompts by class, prompts excluded from resampling."""
    g = group_reward_stats(df, prompt, reward).withColumn("cls", zero_std(max_score))
    solved = F.col("mean_reward") / max_score
    return g.agg(
        F.count("*").alias("total_prompts"),
        F.avg(F.when(F.col("cls").isNull(), solved)).alias("percent_solved_mean"),
        F.count_if(F.col("cls").isNotNull()).alias("filtered_prompts"),
        F.count_if(F.col("cls") == "zero").alias("filtered_prompts_zero"),
        F.count_if(F.col("cls") == "solved").alias("filtered_prompts_solved"),
        F.count_if(F.col("cls") == "other").alias("filtered_prompts_nonzero"),
        (F.count_if(solved >= no_resample_rate) if no_resample_rate is not None else F.lit(0).cast("long")).alias("no_resampled_prompts"),
    )


def step_metrics(df: DataFrame, max_score: float, expected: int, samples_per_prompt: int = 1, score: str = "reward", length: str = "length",
                 advantage: str = "advantage", finish: str = "finish_reason", by: list[str] = ()) -> DataFrame:
    """Metrics of a training step in one aggregate; per group when ``by`` names columns."""
    s, n = F.col(score), F.col(length)
    mean_or_zero = lambda cond: F.coalesce(F.avg(F.when(cond, n)), F.lit(0.0))
    return df.groupBy(*by).agg(
        F.avg(s).alias("scores"),
        (F.count("*") / F.lit(expected)).alias("real_batch_size_ratio"),
        (F.count_if(s < max_score) / F.count("*")).alias("unsolved_batch_size_ratio"),
        (F.count("*") / F.lit(samples_per_prompt)).alias("total_reward_groups"),
        F.avg(n).alias("sequence_lengths"),
        F.min(n).alias("sequence_lengths_min"),
        F.max(n).alias("sequence_lengths_max"),
        mean_or_zero(s == 0).alias("sequence_lengths_unsolved"),
        mean_or_zero(s == max_score).alias("sequence_lengths_solved"),
        F.avg((F.col(finish) == "stop").cast("double")).alias("stop_rate"),
        F.avg(advantage).alias("advantages_mean"),
        F.min(advantage).alias("advantages_min"),
        F.max(advantage).alias("advantages_max"),
    )


def per_verifier_metrics(scores: DataFrame, verifier: str = "verifier", reward: str = "reward") -> DataFrame:
    """Mean reward and share above zero, per verifier and overall (verifier null)."""
    return scores.rollup(verifier).agg(F.avg(reward).alias("mean_reward"), F.avg((F.col(reward) > 0).cast("double")).alias("correct_rate"))


def tool_statistics(df: DataFrame, calls: str = "tool_calls", tools: list[str] = ()) -> DataFrame:
    """Per tool and overall (tool null): calls per rollout, failure rate, mean runtime. The denominator
    counts rollouts without calls too. Tools named in ``tools`` appear even when never called."""
    rollouts = df.agg(F.count("*").alias("rollouts")).scalar()
    c = df.select(F.explode(calls).alias("c")).select("c.*")
    per = c.rollup("tool_name").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.sum("runtime").alias("runtime")
    )
    if tools:
        named = df.sparkSession.createDataFrame([(t,) for t in tools], "tool_name string")
        unused = named.join(per, "tool_name", "left_anti").select("tool_name", F.lit(0).alias("calls"), F.lit(0).alias("failures"), F.lit(0.0).alias("runtime"))
        per = per.unionByName(unused)
    rate = lambda a: F.when(F.col("calls") > 0, F.col(a) / F.col("calls")).otherwise(F.lit(0.0))
    return per.select(
        "tool_name", (F.col("calls") / rollouts).alias("avg_calls_per_rollout"), rate("failures").alias("failure_rate"), rate("runtime").alias("avg_runtime")
    )


def env_metrics(df: DataFrame, env: str, info: str) -> DataFrame:
    """Mean of every numeric info field per environment."""
    return df.select(env, F.explode(info).alias("key", "value")).groupBy(env, "key").agg(F.avg(F.col("value").try_cast("double")).alias("mean")).filter("mean is not null")


def rubric_metrics(df: DataFrame, kind: str = "type", score: str = "score", weight: str = "weight") -> DataFrame:
    """One row: mean and population std of score·weight for evolving and other rubrics, 0 when empty."""
    w = F.col(score) * F.col(weight)
    evolving = F.col(kind) == "evolving"
    part = lambda agg, cond: F.coalesce(agg(F.when(cond, w)), F.lit(0.0))
    other = ~F.coalesce(evolving, F.lit(False))
    return df.agg(
        part(F.avg, evolving).alias("avg_evolving_reward"),
        part(F.stddev_pop, evolving).alias("std_evolving_reward"),
        part(F.avg, other).alias("avg_persistent_reward"),
        part(F.stddev_pop, other).alias("std_persistent_reward"),
    )


def merge_metric_lists(df: DataFrame, key: str, step: str, values: str, size: int = 100_000) -> DataFrame:
    """(key, part, values): the lists of a key concatenated in step order, in parts of ``size`` elements at most, so that a key
    with any share of all records is never one array."""
    elements = df.select(key, step, F.posexplode(values).alias("_at", "_value"))
    return segmented_lists(elements, key, [step, "_at"], {values: F.col("_value")}, size)


def merge_metrics(df: DataFrame, key: str, step: str, number: str | None = None, values: str | None = None, text: str | None = None) -> DataFrame:
    """Merge metric records by key: numbers averaged, lists concatenated in step order, others last. A key's list is one
    array here; where it may be long, ``merge_metric_lists`` gives it in parts."""
    aggs = []
    if number:
        aggs.append(F.avg(number).alias(number))
    if values:
        aggs.append(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(step, values))), lambda s: s[values])).alias(values))
    if text:
        aggs.append(F.max_by(text, step).alias(text))
    return df.groupBy(key).agg(*aggs)


def masked_mean(value: Column, mask: Column) -> Column:
    """Row-wise sum(value·mask)/sum(mask) over arrays; 0 when the mask is empty."""
    total = F.aggregate(F.zip_with(value, mask, lambda v, m: v.cast("double") * m.cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    n = F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def masked_mean_long(df: DataFrame, value: str, mask: str) -> DataFrame:
    n = F.sum(F.col(mask).cast("double"))
    return df.agg(F.when(n > 0, F.sum(F.col(value) * F.col(mask).cast("double")) / n).otherwise(F.lit(0.0)).alias("masked_mean"))


def token_counts(df: DataFrame, group: list[str], mask: str) -> DataFrame:
    """Response tokens, first position excluded, per accumulation group."""
    rest = F.slice(F.col(mask), F.lit(2), F.greatest(F.size(mask), F.lit(1)))
    return df.groupBy(*group).agg(F.sum(F.size(F.filter(rest, lambda m: m != 0))).cast("long").alias("tokens"))


def baseline_projections(df: DataFrame, idx: str = "idx", layer: str = "layer", value: str = "projection") -> DataFrame:
    return df.groupBy(idx, layer).agg(F.avg(value).alias("baseline"), F.count("*").alias("rollouts"))


def layer_summary(baselines: DataFrame, layer: str = "layer") -> DataFrame:
    return baselines.groupBy(layer).agg(
        F.count("*").alias("prompts"), F.avg("baseline").alias("mean"), F.stddev_pop("baseline").alias("std"), F.min("baseline").alias("min"), F.max("baseline").alias("max")
    )


def rubric_update_rates(df: DataFrame, new: str, ground: str, active: str) -> DataFrame:
    """Share of answers with new rubrics, mean counts, skipped answers. ``new`` is null when generation failed."""
    ok = F.col(new).isNotNull()
    mean = lambda c, cond: F.coalesce(F.avg(F.when(cond, F.col(c))), F.lit(0.0))
    return df.agg(
        F.avg(ok.cast("double")).alias("valid_rate"),
        mean(ground, ok).alias("avg_ground_truths"),
        mean(new, ok).alias("avg_new"),
        mean(active, F.col(active).isNotNull()).alias("avg_active"),
        F.count_if(~ok).alias("skipped"),
    )


