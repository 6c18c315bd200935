"""Row filters over conversations.

A message predicate is a function of (role, content) columns. ``any_message`` lifts it over a
``messages`` array; ``flag_conversations`` applies it to a table with one row per message, where the
flag is combined on the map side, so no conversation is ever gathered.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import last
from chatmill.functions.wordlists import ANY_ROLE_KEYWORDS, CUTOFF_PATTERN, PROVIDERS, SELF_REFERENCE_KEYWORDS, identity_pattern

MessagePredicate = Callable[[Column, Column], Column]


def keyword_pattern(keywords: list[str]) -> str:
    return r"\b(?:" + "|".join(k.lower().replace("\\", "\\\\") for k in keywords) + r")\b"


# -- message predicates ---------------------------------------------------------------------------


def mentions_self_reference(role: Column, content: Column, keywords=SELF_REFERENCE_KEYWORDS) -> Column:
    return (role == "assistant") & F.lower(content).rlike(keyword_pattern(keywords))


def mentions_keyword(role: Column, content: Column, keywords=ANY_ROLE_KEYWORDS) -> Column:
    return X.literal_any(content, keywords)


def is_empty_message(role: Column, content: Column) -> Column:
    return X.is_blank(content)


def claims_provider_identity(include_user: bool = False) -> MessagePredicate:
    roles = ["assistant", "user"] if include_user else ["assistant"]
    # every pattern names a provider, so a plain search spares most texts the long patterns
    named = lambda content: X.literal_any(content, [*PROVIDERS, "Alibaba"])
    return lambda role, content: role.isin(roles) & (content.isNull() | (named(content) & content.rlike(identity_pattern())))


def mentions_cutoff(role: Column, content: Column) -> Column:
    return content.rlike(CUTOFF_PATTERN)


def any_message(predicate: MessagePredicate, messages="messages") -> Column:
    m = F.col(messages) if isinstance(messages, str) else messages
    return F.coalesce(F.exists(m, lambda x: F.coalesce(predicate(x["role"], x["content"]), F.lit(False))), F.lit(False))


def drop_any(df: DataFrame, predicate: MessagePredicate, messages: str = "messages") -> DataFrame:
    return df.filter(~any_message(predicate, messages))


def flag_conversations(long: DataFrame, key, **predicates: MessagePredicate) -> DataFrame:
    """One boolean per conversation and predicate, from message rows."""
    return long.groupBy(key).agg(
        *[
            F.coalesce(F.bool_or(F.coalesce(p(F.col("role"), F.col("content")), F.lit(False))), F.lit(False)).alias(name)
            for name, p in predicates.items()
        ]
    )


def drop_keyword_self_reference(df: DataFrame) -> DataFrame:
    return drop_any(df, mentions_self_reference)


def drop_keyword_any_role(df: DataFrame) -> DataFrame:
    return drop_any(df, mentions_keyword)


def drop_empty_message(df: DataFrame) -> DataFrame:
    return drop_any(df, is_empty_message)


def drop_provider_identity(df: DataFrame, include_user: bool = False) -> DataFrame:
    return drop_any(df, claims_provider_identity(include_user))


# -- script ratio ---------------------------------------------------------------------------------


def script_ratio(content: Column, first: str = "一", last: str = "鿿") -> Column:
    inside = F.length(F.regexp_replace(content, f"[^{first}-{last}]", ""))
    return F.when(F.length(content) > 0, inside / F.length(content)).otherwise(F.lit(0.0))


def in_script(content: Column, threshold: float | None = 0.05, first: str = "一", last: str = "鿿") -> Column:
    found = content.rlike(f"[{first}-{last}]")
    return found if threshold is None else found & (script_ratio(content, first, last) >= threshold)


def drop_script_ratio(df: DataFrame, threshold: float | None = 0.05, include_user: bool = False, messages="messages") -> DataFrame:
    """Drop when the final assistant message (or, with ``include_user``, one of the last two
    messages) is written in the script to at least ``threshold``."""
    m = F.col(messages)
    if include_user:
        checked = F.filter(F.slice(m, -F.least(F.size(m), F.lit(2)), F.lit(2)), lambda x: x["role"].isin("assistant", "user"))
        checked = F.when(F.size(m) > 0, checked)
    else:
        checked = F.filter(m, lambda x: x["role"] == "assistant")
        checked = F.when(F.size(checked) > 0, F.slice(checked, -1, 1))
    hit = F.exists(checked, lambda x: F.coalesce(in_script(x["content"], threshold), F.lit(False)))
    return df.filter(~F.coalesce(hit, F.lit(False)))


# -- format, flags, membership --------------------------------------------------------------------

THINK = r"\A<think>[\s\S]*?</think>[\s\S]*?\z"
THINK_ANSWER = r"\A<think>[\s\S]*?</think><answer>[\s\S]*?</answer>\z"


def keep_think_format(df: DataFrame, kind: str = "think", messages="messages") -> DataFrame:
    content = last(F.col(messages))["content"]
    return df.filter(F.coalesce(content.rlike(THINK if kind == "think" else THINK_ANSWER), F.lit(False)))


def cutoff_matches(messages="messages") -> Column:
    return F.flatten(
        F.transform(F.col(messages), lambda m: F.coalesce(F.regexp_extract_all(m["content"], F.lit(CUTOFF_PATTERN), 0), F.array().cast("array<string>")))
    )


def drop_cutoff_mentions(df: DataFrame, ids: str = "id") -> DataFrame:
    """Rows whose id has a mention anywhere go, duplicates of the id included."""
    hit = df.filter(F.size(cutoff_matches()) > 0).select(ids).distinct()
    return df.join(hit, ids, "left_anti")


def cutoff_report(df: DataFrame) -> DataFrame:
    return (
        df.select("source", F.size(cutoff_matches()).alias("n"))
        .filter("n > 0")
        .groupBy("source")
        .agg(F.count("*").alias("examples"), F.sum("n").alias("matches"))
    )


def drop_flag(df: DataFrame, column: str) -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).cast("boolean"), F.lit(False)))


def keep_language(df: DataFrame, language: str, column: str = "language") -> DataFrame:
    return df.filter(F.lower(column) == language.lower())


def drop_sources(df: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).isin(sources), F.lit(False)))


def keep_sources(df: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    return df.filter(F.col(column).isin(sources))


def drop_source_prefix(df: DataFrame, prefix: str, column: str = "source") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))


def keep_model_regex(df: DataFrame, pattern: str, column: str = "model") -> DataFrame:
    return df.filter(F.col(column).rlike(pattern))


def partition_by_predicate(df: DataFrame, parts: dict[str, Column]) -> dict[str, DataFrame]:
    """Split in named subsets; raises unless every row falls in exactly one. One aggregate checks it."""
    inside = sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0))
    bad = df.agg(F.count_if(inside != 1).alias("bad")).first()["bad"]
    if bad:
        raise ValueError(f"{bad} rows are not in exactly one part")
    return {name: df.filter(F.coalesce(c, F.lit(False))) for name, c in parts.items()}


def drop_tags(df: DataFrame, tags: list[str], aliases: dict[str, list[str]] | None = None, column: str = "tags") -> DataFrame:
    """Drop rows whose tags meet the given ones. ``aliases`` maps an accepted tag to its spellings;
    with a table given, tags outside it have no effect. Empty or null tag lists keep the row."""
    names = [t for tag in tags for t in (aliases.get(tag, []) if aliases is not None else [tag])]
    if not names:
        return df
    return df.filter(~F.coalesce(F.arrays_overlap(F.col(column), F.array(*[F.lit(n) for n in names])), F.lit(False)))


def length_filter(df: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """Keep rows where each array or text column has at most the given size; null counts as empty."""
    for column, most in limits.items():
        if most is not None:
            kind = df.schema[column].dataType.typeName()
            size = F.length(column) if kind == "string" else F.when(F.col(column).isNull(), 0).otherwise(F.size(column)) if kind == "array" else F.col(column)
            df = df.filter(F.coalesce(size, F.lit(0)) <= most)
    return df


def has_trainable_label(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns or ("labels",):
        out = out & F.exists(F.col(c), lambda x: x != -100)
    return out


def valid_alternation(roles: Column, first: str = "human", second: str = "gpt") -> Column:
    """Roles strictly alternate starting with ``first``; an empty list is invalid."""
    return (F.size(roles) > 0) & F.forall(
        F.transform(roles, lambda r, i: r == F.when(i % 2 == 0, first).otherwise(second)), lambda ok: ok
    )


def valid_pair(chosen="chosen", rejected="rejected") -> Column:
    def side(c):
        return F.forall(F.col(c), lambda m: F.length(m["content"]) > 0) & (last(F.col(c))["role"] == "assistant")

    return F.coalesce(side(chosen) & side(rejected), F.lit(False))


def drop_marker_leak(df: DataFrame, column: str, markers=("Human:", "Assistant:")) -> DataFrame:
    pattern = "|".join(re.escape(m) for m in markers)
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def drop_ties(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def passrate_between(df: DataFrame, low: float, high: float, column: str = "passrate") -> DataFrame:
    return df.filter(F.col(column).between(low, high))


def drop_identical_completions(df: DataFrame, prompt: str, completion: str) -> DataFrame:
    """Keep prompts with at least two different completions. min < max says so without a distinct."""
    varied = df.groupBy(prompt).agg(F.min(completion).alias("_lo"), F.max(completion).alias("_hi")).filter("_lo < _hi").select(prompt)
    return df.join(varied, prompt, "left_semi")


def require_fields(df: DataFrame, required: list[str], flag: str) -> tuple[DataFrame, Column, Column]:
    """(kept rows, error-count aggregate, skip-count aggregate)."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull()
    skipped = ~missing & ~F.coalesce(F.col(flag), F.lit(False))
    return df.filter(~missing & ~skipped), F.count_if(missing), F.count_if(skipped)


def validate_tools(df: DataFrame, configured: list[str], column: str = "tools") -> list[str]:
    """Raise when the data names tools that are not configured; return configured tools never used."""
    used = df.select(F.explode(column).alias("tool")).distinct()
    unknown = [r["tool"] for r in used.filter(~F.col("tool").isin(configured)).orderBy("tool").limit(20).collect()]
    if unknown:
        raise ValueError(f"tools not configured: {unknown}")
    seen = {r["tool"] for r in used.filter(F.col("tool").isin(configured)).collect()}
    return [t for t in configured if t not in seen]


def count_guard(n_in: int, n_out: int, max_rel_diff: float = 0.01) -> None:
    if n_in and abs(n_in - n_out) / n_in > max_rel_diff:
        raise ValueError(f"output count {n_out} deviates from input count {n_in} by more than {max_rel_diff:.0%}")


def keep_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns hold the given values."""
    for c, v in values.items():
        df = df.filter(F.col(c) == v)
    return df


def keep_stop_only(df: DataFrame, column: str = "finish_reason") -> DataFrame:
    return df.filter(F.col(column) == "stop")


def split_kept(df: DataFrame, predicate: Column, name: str = "kept") -> DataFrame:
    """One pass: rows keep a boolean that a partitioned write separates."""
    return df.withColumn(name, F.coalesce(predicate, F.lit(False)))
