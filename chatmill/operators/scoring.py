"""Scoring jobs over completion tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions import verifiers as V
from chatmill.functions.arrays import last


def _pick(name: Column, p: Column, label: Column, n: Column, table: dict, weights: dict) -> Column:
    """Weighted score by verifier name; null for a name without verifier."""
    out = None
    for k, f in table.items():
        s = f(p, label, n) * F.lit(float(weights.get(k, 1.0)))
        out = F.when(name == k, s) if out is None else out.when(name == k, s)
    return out


def score(df: DataFrame, prediction: str = "prediction", labels: str = "ground_truth", names: str = "dataset", tokens: Column | None = None,
          mult: float = 1.0, weights: dict | None = None, verifiers: dict | None = None, use: list[str] | None = None, override: str | None = None) -> DataFrame:
    """Add ``rewards`` (array of (verifier, reward)) and their sum ``reward``.

    A row carries its labels and verifier names as arrays of equal length, so scoring needs no shuffle:
    the arrays are zipped and folded inside the row. Unknown verifiers are skipped. ``use`` limits the
    verifiers compiled in; ``override`` scores every row with one verifier.
    """
    table = verifiers or V.VERIFIERS
    if use:
        table = {k: table[k] for k in use}
    p, n = F.col(prediction), tokens if tokens is not None else F.lit(0)

    def one(z):
        name = F.lower(z[names])
        if override:
            name = F.lit(override.lower().removeprefix("general-") if override.lower() not in table else override.lower())
        return F.struct(name.alias("verifier"), (F.lit(float(mult)) * _pick(name, p, z[labels], n, table, weights or {})).alias("reward"))

    # names and labels of different number are a data error
    zipped = F.arrays_zip(F.col(names), F.col(labels))
    checked = F.when(F.size(names) != F.size(labels), F.raise_error(F.lit("labels and verifiers differ in number")).cast("array<struct<verifier:string,reward:double>>"))
    rewards = F.filter(F.transform(zipped, one), lambda r: r["reward"].isNotNull())
    out = df.withColumn("rewards", checked.otherwise(rewards))
    return out.withColumn("reward", F.aggregate("rewards", F.lit(0.0), lambda a, r: a + r["reward"]))


def rewards_long(scored: DataFrame, ids: str) -> DataFrame:
    """(ids, verifier, reward): rewards of one response and verifier added up."""
    rows = scored.select(ids, F.explode("rewards").alias("r")).select(ids, "r.*")
    return rows.groupBy(ids, "verifier").agg(F.sum("reward").alias("reward"))


AGGREGATORS = {
    "last": lambda r: F.coalesce(last(r), F.lit(0.0)),
    "sum": lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x),
}


def combine_rewards(verifier_score: Column, format_score: Column | None = None, turn_rewards: Column | None = None, good: Column | None = None,
                    finish_reason: Column | None = None, aggregator: str = "last", additive: bool = False, penalty: float | None = None) -> Column:
    """Final reward of a response.

    The verifier score joins the last turn's reward (or stands alone), turn rewards are aggregated, and
    the format score is added (``additive``) or gates the result (it must equal 1). With ``good`` given,
    other responses keep their format score only. ``penalty`` overrides responses that did not stop.
    """
    base = format_score if format_score is not None else F.lit(0.0)
    raw = verifier_score
    if turn_rewards is not None:
        n = F.size(turn_rewards)
        with_last = F.concat(F.slice(turn_rewards, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.coalesce(last(turn_rewards), F.lit(0.0)) + verifier_score))
        raw = AGGREGATORS[aggregator](F.when(n > 0, with_last).otherwise(F.array(verifier_score)))
    out = raw
    if format_score is not None:
        out = raw + base if additive else F.when(format_score == 1, raw).otherwise(F.lit(0.0))
    if good is not None:
        out = F.when(good, out).otherwise(base)
    if penalty is not None:
        out = F.when(finish_reason != "stop", F.lit(float(penalty))).otherwise(out)
    return out


def good_output(tool_output: str, called: str, timeout: str, error: str) -> Column:
    return (F.length(tool_output) > 0) & F.col(called) & ~F.col(timeout) & ~(F.length(error) > 0)


def code_scores(results: DataFrame, response: str, passed: str, runtime: str | None = None, threshold: float = 0.0, max_seconds: float = 1.0) -> DataFrame:
    """Score of a response from its test results: pass rate, 0 under the threshold; with ``runtime``
    each pass counts for the share of time left."""
    ok = F.col(passed).cast("double")
    aggs = [F.avg(ok).alias("pass_rate")]
    if runtime:
        aggs.append(F.avg(ok * (F.lit(max_seconds) - F.col(runtime)) / F.lit(max_seconds)).alias("timed"))
    s = results.groupBy(response).agg(*aggs)
    score = F.when(F.col("pass_rate") < threshold, F.lit(0.0)).otherwise(F.col("pass_rate"))
    if runtime:
        score = F.when(score > 0, F.col("timed")).otherwise(F.lit(0.0))
    return s.select(response, "pass_rate", score.alias("score"))


def rubric_scores(results: DataFrame, response: str, score: str = "score", weight: str = "weight") -> DataFrame:
    """Σ s·w / Σ |w| with scores 0–2 halved; 0 when the weights cancel out to nothing."""
    w = F.col(weight)
    total = F.sum(F.abs(w))
    return results.groupBy(response).agg(
        F.when(total > 0, F.sum(F.coalesce(F.col(score), F.lit(0.0)) / 2.0 * w) / total).otherwise(F.lit(0.0)).alias("score")
    )
