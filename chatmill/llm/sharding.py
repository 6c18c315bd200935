"""Uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

Partitions are counted; shard sizes are total // shards, one more for the first total % shards. The matrix of how many
rows each partition sends to each shard is drawn row by row from the multivariate hypergeometric law, as a uniform
permutation of all rows would give it. Each task then permutes its own labels, rows are exchanged once, and permuted
again inside the shard by random keys. A shard is cut in cells by the top bits of that key: cells are sorted on their
own and moved on by the counts of those before, so no task holds a shard.

Any column may be null, texts may be empty or very long: rows are not looked at. Repeated rows are separate rows. An
empty table gives no rows. The number of rows a task finds must equal its count, else the job fails; a table read from
files keeps its partitions, anything else is written first (``settled=False``). Clashing extra columns are kept, working
names avoid them.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import fresh
from chatmill.session import materialise

KEY_BITS = 62
CELL_ROWS = 50_000
LEAST_CELL_BITS = 6


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """One draw, for populations of any size: inversion over the mode plus and minus 12 standard deviations."""
    lo, hi = max(0, sample - bad), min(sample, good)
    if lo >= hi:
        return lo
    total = good + bad
    mode = (sample + 1) * (good + 1) // (total + 2)
    sd = sqrt(max(sample * (good / total) * (bad / total) * (total - sample) / max(total - 1, 1), 0.0))
    a, b = max(lo, mode - int(12 * sd) - 12), min(hi, mode + int(12 * sd) + 12)
    x = np.arange(a, b, dtype=np.float64)  # log of p(x + 1) / p(x), added up
    ratio = np.log((good - x) / (x + 1)) + np.log((sample - x) / (bad - sample + x + 1))
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(log_p - log_p.max())
    return a + int(np.searchsorted(np.cumsum(p), rng.random() * p.sum(), "right").clip(0, b - a))


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Rows: partitions, columns: shards; row sums are ``counts``, column sums are ``sizes``."""
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for p, n in enumerate(counts):
        rest, population = n, sum(left)
        for s in range(len(sizes)):
            k = hypergeometric(rng, left[s], population - left[s], rest)
            out[p, s], rest, population = k, rest - k, population - left[s]
            left[s] -= k
    return out


def _labels(row: np.ndarray, seed: int, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and key of each row of a partition: the same whenever a task is run again."""
    rng = np.random.default_rng([seed, part])
    shards = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
    return shards, rng.integers(0, 1 << KEY_BITS, len(shards), dtype=np.int64)


def shard(df: DataFrame, shards: int, seed: int = 23, settled: bool = False, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """``df`` plus its shard (from 0) and its slot there (from 0, without gaps); names that ``df`` has get a leading underscore."""
    spark = df.sparkSession
    df = df if settled else materialise(df, "shard-input")
    names = tuple(fresh(df, *names))
    found = {r["p"]: r["n"] for r in df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()}
    parts, total = sorted(found), sum(found.values())
    matrix = communication_matrix([found[p] for p in parts], [total // shards + (s < total % shards) for s in range(shards)], seed)
    plan = spark.sparkContext.broadcast(dict(zip(parts, matrix)))  # one number per partition and shard
    bits = max(LEAST_CELL_BITS, (max(1, total // (shards * CELL_ROWS)) - 1).bit_length())
    key, cell, before = fresh(df, "_key", "_cell", "_before")
    columns = [*df.columns, names[0], key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        to, keys = _labels(plan.value.get(part, np.zeros(shards, dtype=np.int64)), seed, part)
        for b in batches:
            n = b.num_rows
            if at + n > len(to):
                raise RuntimeError(f"partition {part} has changed since it was counted")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to[at : at + n]), pa.array(keys[at : at + n])], names=columns)
            at += n
        if at != len(to):
            raise RuntimeError(f"partition {part} has changed since it was counted")

    sent = df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(names[0], T.IntegerType()), T.StructField(key, T.LongType())]))
    sent = sent.withColumn(cell, F.shiftright(key, KEY_BITS - bits).cast("int"))
    offsets = _cell_offsets(spark, parts, plan, shards, seed, bits).select(F.col("s").alias("_s"), F.col("c").alias("_c"), F.col("before").alias(before))
    inside = Window.partitionBy(names[0], cell).orderBy(key)
    placed = sent.withColumn(names[1], F.row_number().over(inside).cast("long"))
    placed = placed.join(offsets, (F.col(names[0]) == F.col("_s")) & (F.col(cell) == F.col("_c")), "left")
    return placed.withColumn(names[1], F.col(names[1]) - 1 + F.col(before)).drop(key, cell, before, "_s", "_c")


def _cell_offsets(spark, parts: list[int], plan, shards: int, seed: int, bits: int) -> DataFrame:
    """(s, c, before): rows of shard s in cells before c. Tasks draw their labels again; no data is read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shards << bits, dtype=np.int64)
        for f in frames:
            for p in f["id"]:
                to, keys = _labels(plan.value[parts[p]], seed, parts[p])
                total += np.bincount((to.astype(np.int64) << bits) + (keys >> (KEY_BITS - bits)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"s": (some >> bits).astype(np.int32), "c": (some & ((1 << bits) - 1)).astype(np.int32), "n": total[some]})

    slices = max(1, min(len(parts), spark.sparkContext.defaultParallelism))
    counts = spark.range(0, len(parts), 1, slices).mapInPandas(run, "s int, c int, n long").groupBy("s", "c").agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("s", "c", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


