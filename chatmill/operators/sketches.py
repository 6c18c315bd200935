"""Quantile sketches that merge to the same answer in any order.

A sketch counts values in buckets whose bounds are fixed: every power of two is cut in 2 ** ``bits`` equal parts. Merging
adds counts, so it is exact, commutative and associative; sketches of partitions, files or days can be kept and merged
without reading their rows again. (Spark's own KLL sketches keep random samples: their answers depend on how they were merged.)

An answer is the lower bound, in absolute value, of the bucket that holds the asked rank: with a the answer and x the exact value of that
rank, |a| <= |x| < |a| * (1 + 2 ** -bits), and whole numbers up to 2 ** (bits + 1) are answered exactly. The error in rank is
reported with the answer: it is the first and last rank of that bucket.

Cells, one for each bucket in use, also carry the sum, the sum of squares, the minimum and the maximum of their values, so means and
deviations come out of the same aggregate. A value is reduced to its cell before anything is shuffled; a group with a third of all rows
sends its cells, at most 2 ** bits for each power of two its values span. Nulls and NaN are not counted; infinities have a bucket each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7
LEAST = 1100  # added to exponents, so that keys of positive values are positive
QUARTILES = (0.25, 0.5, 0.75)
CELL = ["n", "total", "squares", "low", "high"]


def bucket(value: Column, bits: int = BITS) -> Column:
    """The number of a value's bucket: in the order of values, 0 for zero; null for null and NaN."""
    v = value.cast("double")
    size = F.abs(v)
    guess = F.floor(F.log2(size))
    power = lambda e: F.pow(F.lit(2.0), e)  # noqa: E731  exact for whole exponents
    e = F.when(power(guess) > size, guess - 1).when(power(guess + 1) <= size, guess + 1).otherwise(guess)
    part = F.floor((size / power(e) - 1) * F.lit(float(1 << bits)))
    key = ((e + LEAST) * (1 << bits) + part + 1).cast("long")
    top = F.lit(((LEAST + 1025) << bits) + 1).cast("long")
    key = F.when(size == float("inf"), top).otherwise(key)
    return F.when(v.isNull() | F.isnan(v), None).when(v == 0, F.lit(0).cast("long")).otherwise(F.when(v < 0, -key).otherwise(key))


def bucket_value(key: Column, bits: int = BITS) -> Column:
    """The bound of a bucket that is nearer to zero."""
    k = F.abs(key) - 1
    e, part = F.floor(k / F.lit(1 << bits)), F.pmod(k, F.lit(1 << bits))
    size = F.when(e >= LEAST + 1025, F.lit(float("inf"))).otherwise(F.pow(F.lit(2.0), (e - LEAST).cast("double")) * (1 + part / F.lit(float(1 << bits))))
    return F.when(key == 0, F.lit(0.0)).when(key < 0, -size).otherwise(size)


def cells(df: DataFrame, measures: dict[str, Column], by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """The sketch of each measure and group as rows: (by..., measure, key, n, total, squares, low, high)."""
    one = F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("x")) for name, c in measures.items()])
    rows = df.select(*by, F.explode(one).alias("_m")).select(*by, "_m.measure", "_m.x").withColumn("key", bucket(F.col("x"), bits)).filter("key is not null")
    return rows.groupBy(*by, "measure", "key").agg(
        F.count("*").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"), F.min("x").alias("low"), F.max("x").alias("high")
    )


def merge(sketches: Sequence[DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """One sketch for each group and measure out of several tables of cells; columns that are not in ``by`` are merged away."""
    every = reduce(DataFrame.unionByName, [s.select(*by, "measure", "key", *CELL) for s in sketches])
    return every.groupBy(*by, "measure", "key").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("low").alias("low"), F.max("high").alias("high"))


def pack(sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row for each group and measure with its cells as a sorted array in column ``sketch``: a bounded value to keep in a table."""
    return sketch.groupBy(*by, "measure").agg(F.sort_array(F.collect_list(F.struct("key", *CELL))).alias("sketch"))


def unpack(packed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return packed.select(*by, "measure", F.explode("sketch").alias("_c")).select(*by, "measure", "_c.*")


def quantiles(sketch: DataFrame, p: Sequence[float] = QUARTILES, by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """(by..., measure, p, value, rank, rank_low, rank_high, n): the value of rank ceil(p * n), 1 at least, and the ranks its bucket holds.

    The window runs over one sketch, which has a bounded number of cells."""
    group = Window.partitionBy(*by, "measure")
    upto = F.sum("n").over(group.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketch.select(*by, "measure", "key", "n", upto.alias("rank_high"), F.sum("n").over(group).alias("_all"))
    asked = ranked.withColumn("p", F.explode(F.array(*[F.lit(float(x)) for x in p]))).withColumn("rank", F.greatest(F.ceil(F.col("p") * F.col("_all")), F.lit(1)).cast("long"))
    hit = asked.filter((F.col("rank") <= F.col("rank_high")) & (F.col("rank") > F.col("rank_high") - F.col("n")))
    return hit.select(*by, "measure", "p", bucket_value(F.col("key"), bits).alias("value"), "rank", (F.col("rank_high") - F.col("n") + 1).alias("rank_low"), "rank_high", F.col("_all").alias("n"))


def summary(sketch: DataFrame, by: Sequence[str] = (), bits: int = BITS) -> DataFrame:
    """(by..., measure, count, mean, std, min, p25, p50, p75, max) of each sketch; min and max are exact."""
    keys = [*by, "measure"]
    n, t = F.sum("n"), F.sum("total")
    spread = F.sqrt(F.greatest((F.sum("squares") - t * t / n) / (n - 1), F.lit(0.0)))
    moments = sketch.groupBy(*keys).agg(n.alias("count"), (t / n).alias("mean"), F.when(n > 1, spread).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"))
    found = quantiles(sketch, QUARTILES, by, bits).groupBy(*keys).agg(*[F.max(F.when(F.col("p") == x, F.col("value"))).alias(f"p{round(100 * x)}") for x in QUARTILES])
    same = reduce(lambda a, b: a & b, [F.col(f"m.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    joined = moments.alias("m").join(found.alias("q"), same)  # a row for each group and measure
    return joined.select(*[F.col(f"m.{k}") for k in keys], "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def message_cells(long: DataFrame, key: str, length: Column, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of the lengths of user and assistant messages and of the turns and lengths of conversations, from message rows."""
    from chatmill.operators.stats import instance_lengths

    per_message = cells(long, {r: F.when(F.col("role") == r, length) for r in ("user", "assistant")}, by)
    per_instance = cells(instance_lengths(long, key, length, list(by)), {"turns": F.col("turns"), "total": F.col("total_length")}, by)
    return per_message.unionByName(per_instance)
