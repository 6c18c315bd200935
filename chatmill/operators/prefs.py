"""Preference pairs and best-of-n selection.

Picking the best or worst row of a group is an aggregate (min_by/max_by over an ordered struct), not a
sort: every task sends one row per group, so a prompt with very many responses costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions.arrays import let
from chatmill.functions.rand import hash_key, hash_pick
from chatmill.operators.ordering import first_per_key, join_stats, segmented_lists, top_n_per_key


def mean_of(columns: list[str]) -> Column:
    total = F.col(columns[0])
    for c in columns[1:]:
        total = total + F.col(c)
    return total / len(columns)


def weighted_sum(weights: dict[str, float]) -> Column:
    total = None
    for name, w in weights.items():
        term = F.lit(w) * F.col(name)
        total = term if total is None else total + term
    return total


def binarize_by_score(df: DataFrame, prompt: str, score: Column, order_by: list[str], response: list[str], min_score: float | None = None,
                      margin: float | None = None, digits: int | None = 2) -> DataFrame:
    """(prompt, chosen_*, rejected_*, chosen_score, rejected_score): best and worst response per prompt.

    Among equals the chosen one is the earliest and the rejected one the latest. Prompts with fewer
    than two responses, equal scores, a best score under ``min_score`` or a gap under ``margin`` go.
    """
    payload = F.struct(*[F.col(c) for c in response], F.col("_s"))
    place = F.struct((-F.col("_s")).alias("_neg"), *[F.col(c) for c in order_by])
    best = df.withColumn("_s", score).groupBy(prompt).agg(
        F.count("*").alias("_n"), F.min_by(payload, place).alias("c"), F.max_by(payload, place).alias("r")
    )
    kept = best.filter((F.col("_n") >= 2) & (F.col("c._s") != F.col("r._s")))
    if min_score is not None:
        kept = kept.filter(F.col("c._s") >= min_score)
    if margin is not None:
        kept = kept.filter(F.col("c._s") - F.col("r._s") >= margin)
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return kept.select(
        prompt,
        *[F.col(f"c.{x}").alias(f"chosen_{x}") for x in response],
        *[F.col(f"r.{x}").alias(f"rejected_{x}") for x in response],
        rounded(F.col("c._s")).alias("chosen_score"),
        rounded(F.col("r._s")).alias("rejected_score"),
    )


def binarize_by_aspects(df: DataFrame, prompt: str, aspects: list[str], order_by, response, ignore=(), **limits) -> DataFrame:
    return binarize_by_score(df, prompt, mean_of([a for a in aspects if a not in ignore]), order_by, response, **limits)


def binarize_weighted(df: DataFrame, prompt: str, weights: dict[str, float], order_by, response, **limits) -> DataFrame:
    return binarize_by_score(df, prompt, weighted_sum(weights), order_by, response, **limits)


def pair_messages(prompt: str, response: str) -> Column:
    return F.array(
        F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")), F.struct(F.lit("assistant").alias("role"), F.col(response).alias("content"))
    )


def binarize_ranked(answers: DataFrame, prompt: str, rank: list[str], text: str, valid: Column, seed, top_n: int = 4) -> DataFrame:
    """Chosen at random among the ``top_n`` best valid answers, rejected at random among all other valid
    answers; prompts with fewer than two valid answers go. Long form: one row per answer."""
    ok = answers.filter(valid)
    top = top_n_per_key(ok, prompt, top_n, [*rank])
    chosen = first_per_key(top, prompt, [hash_key(f"{seed}|chosen", prompt, *rank), *rank]).select(
        prompt, F.col(text).alias("chosen_text"), F.struct(*rank).alias("_c")
    )
    # the two lowest hashes suffice: at most one of them is the chosen answer
    two = top_n_per_key(ok, prompt, 2, [hash_key(f"{seed}|rejected", prompt, *rank), *rank])
    rest = two.join(chosen, prompt).filter(F.struct(*rank) != F.col("_c"))
    rejected = first_per_key(rest.select(prompt, *rank, text, "chosen_text"), prompt, [hash_key(f"{seed}|rejected", prompt, *rank), *rank])
    return rejected.select(prompt, "chosen_text", F.col(text).alias("rejected_text"))


def binarize_pairwise(score_a: str, score_b: str, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(chosen, rejected, margin) by the greater of two scores; null on a tie."""
    s, t = F.col(score_a), F.col(score_b)
    return F.when(s > t, a).when(t > s, b), F.when(s > t, b).when(t > s, a), F.abs(s - t)


def binarize_by_mean_rating(df: DataFrame, ratings: str, completions: str, models: str, seed, ids: str, first: int = 4) -> DataFrame:
    """Chosen = best of the first four mean ratings (lowest index on ties), rejected = another one at
    random. A single rating gives the same index twice."""
    r = F.slice(F.col(ratings), F.lit(1), F.least(F.size(ratings), F.lit(first)))
    best = F.array_position(r, F.array_max(r)).cast("int") - 1
    n = F.size(r)
    other = hash_pick(F.greatest(n - 1, F.lit(1)), seed, ids).cast("int")
    out = df.withColumn("chosen_idx", best)
    out = out.withColumn("rejected_idx", F.when(n == 1, F.col("chosen_idx")).otherwise(other + (other >= F.col("chosen_idx")).cast("int")))
    for side in ("chosen", "rejected"):
        i = F.col(f"{side}_idx")
        out = out.withColumns(
            {f"{side}_text": F.get(F.col(completions), i), f"{side}_model": F.get(F.col(models), i), f"{side}_rating": F.get(F.col(ratings), i)}
        )
    return out.filter(F.size(ratings) > 0)


def best_worst_of_n(scores: DataFrame, prompt: str, model: str, candidate: str, score: str) -> DataFrame:
    """(prompt, model, best, worst): candidate with the highest / lowest score; ties to the lowest index."""
    up, down = F.struct((-F.col(score)).alias("s"), F.col(candidate)), F.struct(F.col(score).alias("s"), F.col(candidate))
    return scores.groupBy(prompt, model).agg(F.min_by(candidate, up).alias("best"), F.min_by(candidate, down).alias("worst"))


def majority_vote(votes: DataFrame, prompt: str, model: str, vote: str, seed) -> DataFrame:
    """(prompt, vote): the most common vote, ties to the lowest model name that cast one; when all
    models disagree, the vote of a random model."""
    tally = votes.groupBy(prompt, vote).agg(F.count("*").alias("n"), F.min(model).alias("first_model"), F.min(hash_key(seed, prompt, model)).alias("h"))
    return tally.groupBy(prompt).agg(
        F.min_by(vote, F.struct((-F.col("n")).alias("n"), "first_model")).alias("common"),
        F.min_by(vote, "h").alias("drawn"),
        F.max("n").alias("most"),
        F.count("*").alias("different"),
    ).select(prompt, F.when((F.col("most") == 1) & (F.col("different") > 1), F.col("drawn")).otherwise(F.col("common")).alias(vote))


def longest_per_parent(df: DataFrame, parent: str, length: Column, ids: str) -> DataFrame:
    return first_per_key(df, parent, [(-length).alias("_len"), F.col(ids)])


def random_per_parent(df: DataFrame, parent: str, seed, ids: str) -> DataFrame:
    return first_per_key(df, parent, [hash_key(seed, ids), F.col(ids)])


def sample_n_per_id(df: DataFrame, key: str, n: int, seed, ids) -> DataFrame:
    """Keys with at least n rows, exactly n of them at random."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    return top_n_per_key(df, key, n, [hash_key(seed, *ids), *ids], min_rows=n)


def sample_k_models(df: DataFrame, prompt: str, model: str, text: str, seed, k: int = 4) -> DataFrame:
    """k random completions of different models per prompt, as aligned arrays; prompts with fewer go
    (``prompts_short_of_models`` lists them)."""
    picked = top_n_per_key(df, prompt, k, [hash_key(seed, prompt, model), F.col(model)], min_rows=k)
    row = F.struct(hash_key(seed, prompt, model).alias("h"), F.col(model).alias("m"), F.col(text).alias("t"))
    return picked.groupBy(prompt).agg(F.sort_array(F.collect_list(row)).alias("_r")).select(
        prompt, F.transform("_r", lambda x: x["m"]).alias("models"), F.transform("_r", lambda x: x["t"]).alias("completions")
    )


def prompts_short_of_models(df: DataFrame, prompt: str, model: str, k: int = 4) -> DataFrame:
    """Prompts that ``sample_k_models`` leaves out, with the number of models they have."""
    return df.groupBy(prompt).agg(F.countDistinct(model).alias("n_models")).filter(F.col("n_models") < k)


def collect_candidates(df: DataFrame, prompt: str, model: str, text: str, query: str, size: int = 1000) -> DataFrame:
    """(prompt, query, part, completions, models): all completions of a prompt and their models in the order of model and
    completion, in parts of ``size`` at most, and the prompt's text. A prompt with any share of all rows is many parts;
    ``mixing.distinct_by_id`` picks one per model before, if wanted."""
    asked = df.groupBy(prompt).agg(F.min_by(query, F.struct(model, text)).alias(query))
    parts = segmented_lists(df.select(prompt, model, text), prompt, [model, text], {"completions": F.col(text), "models": F.col(model)}, size)
    return join_stats(parts, asked, prompt).select(prompt, query, "part", "completions", "models")


def pivot_aspects(df: DataFrame, ids: str, aspect: str, output: str, aspects: list[str]) -> DataFrame:
    """One column per aspect, missing ones empty."""
    return df.groupBy(ids).pivot(aspect, aspects).agg(F.first(output)).na.fill("", aspects)


def aspect_counts(df: DataFrame, aspect: str) -> DataFrame:
    return df.groupBy(aspect).agg(F.count("*").alias("n"))


def mean_ratings(lists: list[str]) -> Column:
    """Element-wise mean over several rating arrays of possibly different length; null and NaN skipped."""
    width = F.greatest(*[F.size(c) for c in lists], F.lit(0))

    def at(i):
        values = F.filter(F.array(*[F.get(F.col(c), i).cast("double") for c in lists]), lambda v: v.isNotNull() & ~F.isnan(v))
        return let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))

    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), at)).otherwise(F.array().cast("array<double>"))


def mean_ratings_long(df: DataFrame, keys: list[str], rating: str) -> DataFrame:
    """The same over a table with one rating per row."""
    return df.groupBy(*keys).agg(F.avg(F.when(~F.isnan(rating), F.col(rating))).alias("mean_rating"))


def parse_rating(c: Column) -> Column:
    """Integer rating, −1 when it is none."""
    return F.coalesce(F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("int")), F.lit(-1))


def win_lose_tie(candidates: DataFrame, references: DataFrame, index: str, text: str, metric) -> DataFrame:
    """Counts of the candidate metric above, below and equal to the reference's."""
    j = candidates.select(index, metric(F.col(text)).alias("a")).join(references.select(index, metric(F.col(text)).alias("b")), index)
    return j.agg(F.count_if(F.col("a") > F.col("b")).alias("win"), F.count_if(F.col("a") < F.col("b")).alias("lose"), F.count_if(F.col("a") == F.col("b")).alias("tie"))


def pair_eval(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """Accuracy, mean −log σ(margin) and mean scores of scored pairs."""
    m = F.col(chosen) - F.col(rejected)
    # log(1 + e^-m) without overflow for large |m|
    loss = F.log1p(F.exp(-F.abs(m))) + F.greatest(-m, F.lit(0.0))
    return df.agg(
        F.avg(F.when(m > 0, 1.0).otherwise(0.0)).alias("accuracy"),
        F.avg(loss).alias("loss"),
        F.avg(chosen).alias("chosen_score"),
        F.avg(rejected).alias("rejected_score"),
        F.avg(m).alias("margin"),
    )
