"""Importance resampling towards a target: hashed feature counts give every document a weight, the highest noisy scores are drawn.

Features are runs of 1 to ``ngrams`` consecutive words (ASCII letters lower-cased, joined by one space), hashed by crc32
into ``buckets``. A bucket's gain is the scaled log ratio of its smoothed shares in the target and in the documents, a
document's weight the sum of its features' gains, and its score the weight plus Gumbel noise that its id decides, so the
highest scores are a draw without replacement by weight.

The gains are one array of ``buckets`` numbers, whatever the input. Scores are written once. The cutoff is then found by
bisection: exact count jobs over the written scores, each counting the thresholds that the next halvings may ask for,
first on the score, then among rows of the cutoff's score on the id, and on for repeated ids. No row is sorted for that;
only drawn rows are range-partitioned, for their ranks, and ties are part of the range key, so equal scores are split.

Null, empty and wordless texts have no features, weight 0 and are never drawn while ``min_words`` is positive. Rows with a
null id share the noise of the empty id and come after all others among equal scores. Repeated rows are rows of their own;
if the cut falls between equal ones, some of them are drawn. Empty documents give no rows, an empty target gives the gains
of no target words. Extra columns are kept, working names avoid them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import ALNUM, LOWER, append_columns, blocks, fresh, words, words_of_rows
from chatmill.session import materialise

LONG_WORD = 64  # bytes; longer words are hashed one by one
HALVINGS = 4  # bisection steps that one count job answers
MAX_LONG = (1 << 63) - 1


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & np.uint32(1), np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


CRC = _crc_table()


def crc_on(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """crc32 of what each ``crc`` stands for, continued by the bytes [start, start + len)."""
    order = np.argsort(-lens, kind="stable")
    s, n = starts[order], lens[order]
    state = ~crc[order]
    long = int(np.searchsorted(-n, -LONG_WORD, "left"))  # these come first
    alive = len(n) - np.searchsorted(n[::-1], np.arange(LONG_WORD), "right")  # words with more than p bytes
    for p in range(LONG_WORD):
        k = int(alive[p])
        if k <= long:
            break
        x = state[long:k]
        state[long:k] = CRC[(x ^ data[s[long:k] + p]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = ~state
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i] : starts[i] + lens[i]], int(crc[i]))
    return out


def features(texts: pa.Array, ngrams: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bucket, row in the block) of all features of a block of texts."""
    space = np.frombuffer(b" ", dtype=np.uint8)
    for lo, hi, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, ends, _ = words(data, ALNUM)
        at = words_of_rows(starts, offsets)
        row = np.repeat(np.arange(hi - lo), np.diff(at))
        lens, left = ends - starts, at[1:][row] - np.arange(len(row))  # words from here to the row's end
        crc = crc_on(np.zeros(len(row), dtype=np.uint32), data, starts, lens)
        found, rows, here = [crc], [row], np.arange(len(row))
        for n in range(2, ngrams + 1):
            on = left[here] >= n
            here, crc = here[on], crc[on]
            crc = crc_on(crc, space, np.zeros(len(here), dtype=np.int64), np.ones(len(here), dtype=np.int64))
            crc = crc_on(crc, data, starts[here + n - 1], lens[here + n - 1])
            found.append(crc)
            rows.append(row[here])
        yield lo, hi - lo, (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(rows)


def bucket_counts(docs: DataFrame, text: str, ngrams: int, buckets: int) -> np.ndarray:
    """How many features each bucket holds, over all rows; a task sends one sum for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for _, _, bucket, _ in features(b.column(0), ngrams, buckets):
                total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    sums = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in sums.collect():  # ``buckets`` rows at most
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln(share in the target / share in the documents)) of each bucket, both counts plus one."""
    n, m, k = float(documents.sum()), float(target.sum()), float(len(documents))
    return np.array([math.floor(scale * math.log((t + 1.0) * (n + k) / ((s + 1.0) * (m + k)))) for s, t in zip(documents.tolist(), target.tolist())], dtype=np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, ngrams: int = 1, text: str = "text", names: tuple[str, str] = ("n_features", "weight")) -> DataFrame:
    """``docs`` plus, under ``names``, the number of features and the sum of their gains."""

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        count, total = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for lo, n, bucket, row in features(texts, ngrams, len(gain)):
            count[lo : lo + n] = np.bincount(row, minlength=n)
            total[lo : lo + n] = np.bincount(row, gain[bucket], n).astype(np.int64)  # exact: far below 2 ** 53
        return [pa.array(count), pa.array(total)]

    return append_columns(docs, text, [T.StructField(n, T.LongType()) for n in names], per_batch)


def noise(ident: Column, seed: int, scale: int = 1000) -> Column:
    """floor(scale * Gumbel) from the first 32 bits of sha256(``seed:id``)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(float(-scale)) * F.log(-F.log(unit))).cast("long")


def _smallest(rows: DataFrame, key: str, need: int) -> tuple[int, int, int]:
    """(v, rows below v, rows at v): v is the smallest value of ``key`` up to which at least ``need`` rows lie."""
    r = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    lo, hi, below, upto = r["lo"], r["hi"], 0, r["n"]
    while lo < hi:
        steps = 1 << HALVINGS
        cuts = sorted({lo + (hi - lo) * i // steps for i in range(1, steps)} - {hi} | {lo})
        inside = rows.filter(F.col(key).between(lo, hi))
        got = inside.agg(*[F.count(F.when(F.col(key) <= c, 1)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        counts = [below + n for n in got]
        first = next((i for i, n in enumerate(counts) if n >= need), len(cuts))
        if first:
            lo, below_new = cuts[first - 1] + 1, counts[first - 1]
        else:
            below_new = below
        if first < len(cuts):
            hi, upto = cuts[first], counts[first]
        below = below_new
    return lo, below, upto - below


def cutoff(rows: DataFrame, keys: list[str], need: int) -> list[int]:
    """Values of the leading ``keys`` that close the first ``need`` rows of ``rows`` in the order of ``keys`` (longs, unique
    together). ``need`` is at least 1 and at most the number of rows. Later keys are left out if they decide nothing."""
    out: list[int] = []
    for k in keys:
        v, below, here = _smallest(rows, k, need)
        out.append(v)
        need -= below
        if here == need:
            break
        rows = rows.filter(F.col(k) == v)
    return out


def up_to(keys: list[str], values: list[int]) -> Column:
    """Whether a row comes before or at the cutoff."""
    k, v = F.col(keys[0]), F.lit(values[0])
    return (k < v) | ((k == v) & up_to(keys[1:], values[1:])) if len(values) > 1 else k <= v


def draw(scored: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, ident: str = "doc_id", names: tuple[str, str, str, str] = ("n_features", "words", "score", "rank")) -> DataFrame:
    """``scored`` plus a rank: 1, 2, 3 ... by falling score for the share of the rows of ``min_words`` or more words, else null."""
    n_features, n_words, score, rank = names
    top, tie, row, part, place, before = work = fresh(scored, "_top", "_tie", "_row", "_part", "_place", "_before")
    keys = [top, tie, n_features, row]
    kept = materialise(
        scored.withColumn(top, -F.col(score))
        .withColumn(tie, F.coalesce(F.col(f"`{ident}`").cast("long"), F.lit(MAX_LONG)))
        .withColumn(row, F.monotonically_increasing_id()),
        "importance-scores",
    )
    fit = kept.filter(F.col(n_words) >= min_words)
    need = share[0] * fit.count() // share[1]
    none = F.lit(None).cast("long")
    if not need:
        return kept.withColumn(rank, none).drop(*work)
    values = cutoff(fit, keys, need)
    chosen = (F.col(n_words) >= min_words) & up_to(keys, values)
    line = kept.filter(chosen).repartitionByRange(*keys).sortWithinPartitions(*keys)
    line = materialise(line.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "importance-ranks")
    earlier = Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    moved = line.groupBy(part).agg(F.count("*").alias(before)).withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    ranked = line.join(F.broadcast(moved), part).withColumn(rank, (F.col(before) + F.col(place) + 1).cast("long"))
    return ranked.drop(*work).unionByName(kept.filter(~chosen).withColumn(rank, none).drop(*work))


def score(docs: DataFrame, target: DataFrame, ngrams: int = 1, buckets: int = 10_000, seed: int = 2024, text: str = "text", target_text: str = "text", ident: str = "doc_id", names: tuple[str, str, str] = ("n_features", "weight", "score")) -> DataFrame:
    """``docs`` plus, under ``names``, the number of features, their weight and the noisy score."""
    gain = gains(bucket_counts(docs, text, ngrams, buckets), bucket_counts(target, target_text, ngrams, buckets))
    return weigh(docs, gain, ngrams, text, names[:2]).withColumn(names[2], F.col(names[1]) + noise(F.col(f"`{ident}`"), seed))


def word_count(n_features: Column, ngrams: int) -> Column:
    """The words of a text by its number of features: w words have w + (w - 1) + ... runs of 1 to ``ngrams`` words."""
    lost = ngrams * (ngrams - 1) // 2
    short = [w * (w + 1) // 2 for w in range(ngrams)]  # features of a text of w < ngrams words
    out = ((n_features + lost) / ngrams).cast("long")
    for w, f in enumerate(short):
        out = F.when(n_features == f, F.lit(w).cast("long")).otherwise(out)
    return out


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), ngrams: int = 1, min_words: int = 20, **options) -> DataFrame:
    """The drawn documents, with their own columns."""
    n_features, weight, noisy, words_, rank = fresh(docs, "_n_features", "_weight", "_score", "_words", "_rank")
    scored = score(docs, target, ngrams, names=(n_features, weight, noisy), **options).withColumn(words_, word_count(F.col(n_features), ngrams))
    drawn = draw(scored, share, min_words, options.get("ident", "doc_id"), (n_features, words_, noisy, rank))
    return drawn.filter(F.col(rank).isNotNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
