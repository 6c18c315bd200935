"""Named transforms applied in order, and whole mixes built from a specification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatmill.operators import filters, mixing, pack
from chatmill.operators.ordering import dense_index
from chatmill.plans.cache import cached, config_hash, fingerprint

Transform = Callable[..., DataFrame]
REGISTRY: dict[str, tuple[Transform, str]] = {}


def transform(name: str, kind: str):
    """Register a map or filter under a name."""
    if kind not in ("map", "filter"):
        raise ValueError("kind is map or filter")

    def register(fn: Transform) -> Transform:
        REGISTRY[name] = (fn, kind)
        return fn

    return register


@transform("encode_plain", "map")
def _(df, encode, **kw):
    return pack.encode_chat(df, encode, mode="none", **kw)


@transform("encode_prompt_masked", "map")
def _(df, encode, **kw):
    return pack.encode_chat(df, encode, mode="prompt", **kw)


@transform("encode_chat", "map")
def _(df, encode, **kw):
    return pack.encode_chat(df, encode, mode="assistant", **kw)


@transform("encode_last_turn", "map")
def _(df, encode, **kw):
    return pack.encode_chat(df, encode, mode="last_turn", **kw)


@transform("encode_preference", "map")
def _(df, encode, **kw):
    return pack.encode_preference(df, encode, **kw)


@transform("encode_verifiable", "map")
def _(df, encode, **kw):
    return pack.encode_verifiable(df, encode, **kw)


@transform("max_length", "filter")
def _(df, **limits):
    return filters.length_filter(df, limits)


@transform("has_label", "filter")
def _(df, columns=("labels",)):
    return df.filter(filters.has_trainable_label(*columns))


def apply_transforms(df: DataFrame, steps: list[tuple[str, dict]], keep: list[str] | None = None, always: tuple[str, ...] = ("id", "source"), check_empty: bool = True) -> DataFrame:
    """Run the named steps in order, then keep the target columns and those always preserved. An empty
    result is an error."""
    for name, args in steps:
        if name not in REGISTRY:
            raise ValueError(f"unknown transform {name!r}")
        fn, _ = REGISTRY[name]
        df = df.transform(lambda d: fn(d, **args))
    if keep is not None:
        df = df.select(*[c for c in df.columns if c in keep or c in always])
    if check_empty and df.isEmpty():
        raise ValueError("no rows are left after the transforms")
    return df


@dataclass(frozen=True)
class MixSpec:
    """A mix as its users state it: alternating names and amounts, splits, transforms and seed."""

    items: tuple
    splits: tuple[str, ...] = ("train",)
    steps: tuple = ()
    keep: tuple[str, ...] | None = None
    seed: int = 42
    ids: str = "id"
    extra: dict = field(default_factory=dict)


def build_mix(spark: SparkSession, spec: MixSpec, sources: dict[str, DataFrame], step_args: dict[str, dict] | None = None, root: str | None = None, skip_cache: bool = False):
    """(rows with a dense index, statistics per source): resample, transform, index, keep under its hash.

    With a cache folder every source's resampled and transformed rows are a part of their own, named by the content of the
    source: when one source has changed only its part is built again, and the index over all parts. Without ``sources`` the
    table built last for this specification is read.
    """

    def part(items: list, splits: list[str], given: dict[str, DataFrame]):
        mixed, sizes = mixing.mix(given, items, spec.ids, spec.seed, splits)
        steps = [(name, {**args, **(step_args or {}).get(name, {})}) for name, args in spec.steps]
        return apply_transforms(mixed, steps, list(spec.keep) + ["copy"] if spec.keep else None, (spec.ids, "source"), False), spark.createDataFrame(sizes)

    def whole(done: DataFrame, sizes: DataFrame):
        if done.isEmpty():
            raise ValueError("no rows are left after the transforms")
        rows = dense_index(done, ["source", "copy", spec.ids])
        final = rows.groupBy("source").agg(F.count("*").alias("final_instances"))
        stats = sizes.join(final, "source", "left").na.fill(0, ["final_instances"])
        return rows, stats.withColumn("instances_filtered", F.col("initial_instances") - F.col("final_instances"))

    if root is None or skip_cache:
        return whole(*part(list(spec.items), list(spec.splits), sources))
    home = f"{root.rstrip('/')}/{config_hash(spec)}"
    if not sources:
        prints = [r["value"] for r in spark.read.text(f"{home}/current").orderBy("value").collect()]  # a line for each source
        return cached(spark, home, prints, lambda: (_ for _ in ()).throw(ValueError("this mix has not been built")))
    wanted = mixing.parse_mix(list(spec.items), list(spec.splits))
    known = {name: fingerprint(sources[name]) for name in {name for name, _, _ in wanted}}
    prints = [f"{i:06d} {name} {known[name]}" for i, (name, _, _) in enumerate(wanted)]

    def build():
        parts = [
            cached(spark, f"{home}/parts", mark, lambda i=i, name=name, split=split: part([name, spec.items[2 * i + 1]], [split], {name: sources[name]}))
            for i, (mark, (name, _, split)) in enumerate(zip(prints, wanted))
        ]
        return whole(*[reduce(DataFrame.unionByName, x) for x in zip(*parts)])

    out = cached(spark, home, prints, build)
    spark.createDataFrame([(p,) for p in prints], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/current")
    return out
