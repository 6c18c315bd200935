"""Shared pieces: Arrow batches as blocks of bytes, vectorised words, appended columns, bounded label samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 2 << 20  # text handled at once inside a task; a longer text is a block of its own
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UPPER = "".join(map(chr, range(65, 91)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, changed where ``df`` has a column that a case-insensitive session would confuse with them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def append_columns(df: DataFrame, column: str, fields: list[T.StructField], per_batch: Callable) -> DataFrame:
    """``df`` plus ``fields``; ``per_batch`` maps the Arrow array of ``column`` to the arrays of the new fields."""
    at = df.columns.index(column)
    names = [*df.columns, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, *per_batch(b.column(at))], names=names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, n + 1 offsets). A space follows each text; null counts as empty."""
    sizes = np.fromiter((len(x) for x in _raw(texts)), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes + 1)
    lo = 0
    while lo < len(texts):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        joined = b" ".join(_raw(texts.slice(lo, hi - lo))) + b" "
        yield lo, hi, np.frombuffer(joined, dtype=np.uint8), np.concatenate([[0], ends[lo:hi] - base])
        lo = hi


def _raw(texts: pa.Array) -> list[bytes]:
    return texts.cast(pa.large_binary()).fill_null(b"").to_pylist()


def letters(separators: str) -> np.ndarray:
    """Table of the bytes that belong to words: all but the given ASCII ranges."""
    out = np.ones(256, dtype=bool)
    for r in separators.split():
        a, _, b = r.partition("-")
        out[int(a, 16) : int(b or a, 16) + 1] = False
    return out


NOT_SPACE = letters("20 09-0D")
ALNUM = letters("00-2F 3A-60 7B-7F")  # after lower-casing
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, 64-bit hash) of each word; the last byte of ``data`` must be a separator."""
    inside = in_word[data]
    if not inside.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    lens = ends - starts
    first = np.cumsum(lens) - lens
    within = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lens.max()), MULTIPLIER, dtype=np.uint64))
        hashes = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * powers[within], first)
        hashes = mix64(hashes + lens.astype(np.uint64))
    return starts, ends, hashes


def words_of_rows(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n + 1 offsets of the rows' words, from the words' starts and the rows' byte offsets."""
    return np.searchsorted(starts, offsets, "left")


def bounded_labels(labels: DataFrame, label: str, max_rows: int, seed: int) -> DataFrame:
    """(doc_id, label): about ``max_rows`` labelled ids at most, half of them of each class, chosen by hash.

    A documented bound for fitting: the classes are counted over all labels, and the share of each that is
    taken follows from its count, so the sample is small enough to broadcast. Ids labelled both ways are left out.
    """
    one = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_top"))
        .filter("label = _top").select("doc_id", "label")
    )
    n = {r["label"]: r["n"] for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) / F.lit(1e6)
    share = F.when(F.col("label") == 1, min(1.0, max_rows / 2 / max(n.get(1, 0), 1))).otherwise(min(1.0, max_rows / 2 / max(n.get(0, 0), 1)))
    return one.filter(unit < share)


def one_text_each(sample: DataFrame, text: str) -> DataFrame:
    """(doc_id, label, text) of a labelled sample with one row for each id, so that repeated ids do not lengthen it."""
    return sample.groupBy("doc_id", "label").agg(F.min_by(text, F.xxhash64(text)).alias(text))


def class_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """How many labelled rows are 0 and 1, over all labels."""
    r = labels.agg(*[F.sum((F.col(label) == k).cast("long")).alias(f"n{k}") for k in (0, 1)]).first()
    return r["n0"] or 0, r["n1"] or 0


def remainder(n: int) -> Column:
    """crc32 of the id's text, modulo ``n``: the fold of a document."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
