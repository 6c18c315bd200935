"""Mixing and resampling of sources."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.operators.ordering import BUCKET, CUT, _null_safe_join, first_per_key, of_last_bucket, sample_exact, with_cut
from chatmill.session import materialise

log = logging.getLogger(__name__)


def parse_amount(text: str | int | float) -> int | float:
    """With a point a proportion, without one a row count."""
    if isinstance(text, str):
        return float(text) if "." in text else int(text)
    return text


def parse_mix(items: list, splits: list[str] | None = None) -> list[tuple[str, int | float, str]]:
    """Alternating name/amount list with one split for all or one per list item."""
    if len(items) % 2:
        raise ValueError("mix list must alternate names and amounts")
    splits = splits or ["train"]
    if len(splits) == 1:
        splits = splits * len(items)
    elif len(splits) != len(items):
        raise ValueError("give one split, or as many as the mix list has items")
    return [(items[i], parse_amount(items[i + 1]), splits[i]) for i in range(0, len(items), 2)]


def target_size(amount: int | float, size: int) -> int:
    return int(amount * size) if isinstance(amount, float) else int(amount)


def check_amount(name: str, amount: int | float, size: int) -> None:
    if isinstance(amount, int) and amount <= 10 and size > 100:
        log.warning("source %s: only %d of %d rows; did you mean %.1f, a proportion?", name, amount, size, float(amount))


def resample(df: DataFrame, target: int, size: int, seed, ids) -> DataFrame:
    """target // size whole copies plus target % size distinct random rows. ``copy`` numbers the copies
    of a row, extras carry the highest number."""
    if size <= 0:
        if target:
            raise ValueError("cannot sample from an empty source")
        return df.withColumn("copy", F.lit(0))
    copies, extra = divmod(target, size)
    parts = []
    if copies:
        parts.append(df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))))
    if extra:
        parts.append(sample_exact(df, extra, seed, ids).withColumn("copy", F.lit(copies + 1)))
    return reduce(DataFrame.unionByName, parts) if parts else df.limit(0).withColumn("copy", F.lit(0))


def resample_by_source(df: DataFrame, sizes: DataFrame, source: str, seed, ids) -> DataFrame:
    """``resample`` of every source of one table at once. ``sizes``: (source, size, target), one row per source;
    a null source is a source. One pass gives every row its whole copies and, where its bucket lies under the
    quota of extras, one more; only the bucket that fills the quota is read again and ranked."""
    return _resampled(_null_safe_join(df, materialise(sizes.select(source, "size", "target"), "sizes"), [source]), source, seed, ids)


def _resampled(sized: DataFrame, source: str, seed, ids) -> DataFrame:
    """The same for rows that carry their source's size and target."""
    cut = with_cut(sized, F.col("target") % F.col("size"), seed, ids, [source])
    copies = F.floor(F.col("target") / F.col("size")).cast("int")
    whole = copies + F.coalesce(F.col(BUCKET) < F.col("_last"), F.lit(False)).cast("int")
    repeated = cut.withColumn("_k", whole).filter("_k > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_k")))).drop("_k")
    filling = of_last_bucket(cut, ids, [source]).withColumn("copy", copies + 1)
    return repeated.unionByName(filling).drop("size", "target", *CUT)


def _tagged(sources: list[DataFrame], name: str) -> DataFrame:
    """All sources as one table, ``name`` holding the position of each in the list."""
    return concatenate([df.withColumn(name, F.lit(i)) for i, df in enumerate(sources)])


def _counts(sources: list[DataFrame]) -> list[int]:
    """Rows of each source, all counted in one job."""
    n = {r["_at"]: r["count"] for r in _tagged([df.select() for df in sources], "_at").groupBy("_at").count().collect()}  # one row per source
    return [n.get(i, 0) for i in range(len(sources))]


def mix(sources: dict[str, DataFrame], items: list, ids: str, seed=42, splits: list[str] | None = None, column: str = "source") -> tuple[DataFrame, list[dict]]:
    """Build a mix from an alternating name/amount list: (rows, one record of sizes per source)."""
    wanted = parse_mix(items, splits)
    tables = [_of_split(sources[name], split) for name, _, split in wanted]
    counts = _counts(tables)
    sizes = _sizes(wanted, counts, column)
    named = [df if column in df.columns else df.withColumn(column, F.lit(name)) for df, (name, _, _) in zip(tables, wanted)]
    tagged = _with_sizes(_tagged(named, "_at"), "_at", {i: (n, s["initial_instances"]) for i, (n, s) in enumerate(zip(counts, sizes)) if n})
    return _resampled(tagged, "_at", seed, ids).drop("_at"), sizes


def mix_table(df: DataFrame, items: list, ids: str, seed=42, column: str = "source") -> tuple[DataFrame, list[dict]]:
    """The same mix out of one table that holds all sources, told apart by ``column``: its passes do not grow with their number.
    Every source is named once."""
    wanted = parse_mix(items)
    if len({name for name, _, _ in wanted}) < len(wanted):
        raise ValueError("a source is named twice")
    part = df.filter(F.col(column).isin([name for name, _, _ in wanted]))
    found = {r[column]: r["count"] for r in part.groupBy(column).count().collect()}  # one row for each name
    counts = [found.get(name, 0) for name, _, _ in wanted]
    sizes = _sizes(wanted, counts, column)
    part = _with_sizes(part, column, {name: (n, s["initial_instances"]) for (name, _, _), n, s in zip(wanted, counts, sizes) if n})
    return _resampled(part, column, seed, ids), sizes


def _with_sizes(df: DataFrame, source: str, sizes: dict) -> DataFrame:
    """``df`` plus size and target of its source, out of a mix list; no join is needed for so few values."""
    look = lambda k: F.element_at(F.create_map(*[F.lit(x) for key, v in sizes.items() for x in (key, v[k])]), F.col(source)).cast("long")
    return df.withColumns({"size": look(0), "target": look(1)}) if sizes else df.withColumns({c: F.lit(None).cast("long") for c in ("size", "target")})


def _sizes(wanted: list[tuple], counts: list[int], column: str) -> list[dict]:
    """One record of sizes per source of a mix list."""
    sizes = []
    for (name, amount, split), n in zip(wanted, counts):
        want = target_size(amount, n)
        check_amount(name, amount, n)
        if want and not n:
            raise ValueError("cannot sample from an empty source")
        sizes.append(
            {
                column: name, "dataset_split": split, "initial_instances": want, "original_dataset_size": n, "amount": str(amount),
                "is_upsampled": want > n, "upsampling_factor": want / n if n else 1.0,
            }
        )
    return sizes


def _of_split(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split) if "split" in df.columns else df


def _firsts(sources: list[DataFrame], quotas: list[int], ids: str, seed) -> DataFrame:
    """The first rows of each source in hash order, up to its quota; all sources in the same passes."""
    quota = F.element_at(F.array(*[F.lit(int(q)) for q in quotas]), F.col("_at") + 1)
    return sample_exact(_tagged(sources, "_at"), quota, seed, ids, ["_at"]).drop("_at")


def _named(sources: dict[str, DataFrame], names) -> list[DataFrame]:
    return [sources[n] if "source" in sources[n].columns else sources[n].withColumn("source", F.lit(n)) for n in names]


def mix_fixed(sources: dict[str, DataFrame], amounts: dict[str, int | float], ids: str, seed=42) -> DataFrame:
    """Older mixer: shuffle, then the first fraction or count; any amount over 1 makes all counts.
    Negative amounts and a blend of fractions and counts are errors."""
    if any(a < 0 for a in amounts.values()):
        raise ValueError("amounts cannot be negative")
    counts = any(a > 1 for a in amounts.values())
    if counts and not all(isinstance(a, int) for a in amounts.values()):
        raise NotImplementedError("fractions and counts cannot be blended")
    tables = _named(sources, amounts)
    quotas = list(amounts.values()) if counts else [int(a * n) for a, n in zip(amounts.values(), _counts(tables))]
    return _firsts(tables, quotas, ids, seed)


def combine(sources: dict[str, DataFrame], amounts: dict[str, float], ids: str, seed=42, splits: dict[str, str] | None = None) -> DataFrame:
    """Per-source split; an amount over 1.0 is a count, else a fraction. Test rows are never subsampled."""
    split = {name: (splits or {}).get(name, "train") for name in amounts}
    tables = dict(zip(amounts, [_of_split(df, split[n]) for n, df in zip(amounts, _named(sources, amounts))]))
    drawn = [n for n in amounts if split[n] != "test"]
    parts = [tables[n] for n in amounts if split[n] == "test"]
    if drawn:
        sizes = _counts([tables[n] for n in drawn])
        quotas = [int(amounts[n]) if amounts[n] > 1.0 else int(amounts[n] * size) for n, size in zip(drawn, sizes)]
        parts.append(_firsts([tables[n] for n in drawn], quotas, ids, seed))
    return concatenate(parts)


def stratified_portions(df: DataFrame, portions: dict[str, float], total: int, column: str, seed, ids) -> DataFrame:
    """floor(portion · total) distinct random rows per task; portions sum to 1."""
    if abs(sum(portions.values()) - 1.0) > 1e-6:
        raise ValueError("portions must sum to 1")
    quota = F.create_map(*[F.lit(x) for k, p in portions.items() for x in (k, int(p * total))])
    kept = df.filter(F.col(column).isin(list(portions)))
    return sample_exact(kept, F.element_at(quota, F.col(column)), seed, ids, [column])


def sample_per_task(df: DataFrame, task: str, shot: str, k0: int, k1: int, seed, ids, skip: list[str] = ()) -> DataFrame:
    """Per task up to k0 zero-shot and k1 few-shot rows, named tasks left out. ``shot`` is boolean."""
    kept = df.filter(~F.col(task).isin(list(skip))) if skip else df
    return sample_exact(kept, F.when(F.col(shot), k1).otherwise(k0), seed, ids, [task, shot])


def sample_unique(df: DataFrame, key: str, limit: int, seed, order_by, keep: str = "last") -> DataFrame:
    """Distinct keys (last or first row wins), then a random sample."""
    return sample_exact(first_per_key(df, key, order_by, keep), limit, seed, key)


def distinct_by_id(df: DataFrame, key: str, order_by) -> DataFrame:
    """First row per id in a stated order."""
    return first_per_key(df, key, order_by)


def concatenate(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
