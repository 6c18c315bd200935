"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows are its runs of ``size`` consecutive words (a shorter item is one window). A document that contains
a window must contain every word of it, so one word is a sufficient prefix; words are ordered by how often they occur
in the whole corpus and the window's rarest one is its prefix. A document joins only where it has that word; the word's
place in the window and the document's length bound where the window may lie, and the words there are compared one by
one. The benchmark side is cut in slices of bounded size, each broadcast; documents pass all slices in one scan and are
never shuffled.

Null or wordless texts have no words, no hits and are clean; wordless items have no windows. An item that repeats
another's text is reported as well; items without an id mark words but cannot be listed. Repeated documents are judged
one by one. Clashing extra columns are kept, working names avoid them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import ALNUM, LOWER, append_columns, blocks, fresh, words, words_of_rows

SLICE_BYTES = 64 << 20
FILTER_BITS = 20


def _row_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes of the block, n + 1 word offsets of its rows)."""
    for lo, _, data, offsets in blocks(texts):
        data = LOWER[data]
        starts, _, hashes = words(data, ALNUM)
        yield lo, hashes, words_of_rows(starts, offsets)


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, window): window holds the word hashes as bytes, one row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            names = b.column(0).to_pylist()
            for lo, hashes, at in _row_words(b.column(1)):
                for k in range(len(at) - 1):
                    w = hashes[at[k] : at[k + 1]]
                    for i in range(max(len(w) - size + 1, min(len(w), 1))):
                        ids.append(names[lo + k])
                        wins.append(w[i : i + size].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(wins, pa.binary())], names=["item", "window"])

    return benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "item string, window binary")


def word_counts(docs: DataFrame, vocabulary: np.ndarray, text: str) -> dict[int, int]:
    """How often each word of the (sorted) vocabulary occurs in all documents; tasks return sums, not words."""
    maybe = _filter(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary) + 1, dtype=np.int64)
        for b in batches:
            for _, hashes, _ in _row_words(b.column(0)):
                h = hashes[maybe[hashes >> np.uint64(64 - FILTER_BITS)]]
                at = np.searchsorted(vocabulary, h)
                found = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h
                total[:-1] += np.bincount(at[found], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["word", "n"])

    counted = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    return {int(vocabulary[w]): int(n) for w, n in zip(counted["word"], counted["n"])}


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    out[hashes >> np.uint64(64 - FILTER_BITS)] = True
    return out


class WindowIndex:
    """Windows of one slice by their rarest word."""

    def __init__(self, windows: pd.DataFrame, counts: dict[int, int]):
        grouped = windows.groupby("window", sort=True)["item"].agg(lambda x: sorted({i for i in x if i is not None}))
        self.items: list[list[str]] = list(grouped)
        self.windows = [np.frombuffer(w, dtype=np.uint64) for w in grouped.index]
        self.by_word: dict[int, list[tuple[int, int]]] = {}
        for k, w in enumerate(self.windows):
            place = min(range(len(w)), key=lambda i: (counts.get(int(w[i]), 0), i))
            self.by_word.setdefault(int(w[place]), []).append((place, k))
        self.words = np.array(sorted(self.by_word), dtype=np.uint64)
        self.maybe = _filter(self.words)

    def find(self, hashes: np.ndarray, at: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Per row of a block: word spans covered by windows, and the items they come from."""
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        if not len(self.words):
            return out
        near = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        place = np.minimum(np.searchsorted(self.words, hashes[near]), len(self.words) - 1)
        near = near[self.words[place] == hashes[near]]
        rows = np.searchsorted(at, near, "right") - 1
        for i, r in zip(near.tolist(), rows.tolist()):
            lo, hi = at[r], at[r + 1]
            for offset, k in self.by_word[int(hashes[i])]:
                w = self.windows[k]
                start = i - offset
                if start >= lo and start + len(w) <= hi and np.array_equal(hashes[start : start + len(w)], w):
                    spans, items = out.setdefault(r, ([], set()))
                    spans.append((int(start - lo), int(start - lo + len(w))))
                    items.update(self.items[k])
        return out


def _slices(benchmark: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """Windows in slices of at most about SLICE_BYTES, by hash, so that one content is in one slice."""
    windows = item_windows(benchmark, size).repartition("window")
    total = windows.agg(F.sum(F.length("window") + F.coalesce(F.length("item"), F.lit(0)) + 64).alias("n")).first()["n"] or 0
    n = max(1, -(-total // SLICE_BYTES))
    for k in range(n):
        yield windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k).toPandas()


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", names: tuple[str, ...] = ("n_words", "spans", "items")) -> DataFrame:
    """``docs`` plus, under ``names``: number of words, covered word spans (array of [start, end)), item ids (sorted array)."""
    n_words, spans, items = fresh(docs, *names)
    fields = [
        T.StructField(n_words, T.LongType()),
        T.StructField(spans, T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField(items, T.ArrayType(T.StringType())),
    ]
    context = docs.sparkSession.sparkContext
    passes = list(_indices(docs, benchmark, size, text))
    shared = [context.broadcast(x) for x in passes]

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        count, found, ids = np.zeros(len(texts), dtype=np.int64), [[] for _ in range(len(texts))], [set() for _ in range(len(texts))]
        for lo, hashes, at in _row_words(texts):
            count[lo : lo + len(at) - 1] = np.diff(at)
            for index in shared:
                for r, (s, i) in index.value.find(hashes, at).items():
                    found[lo + r] += s
                    ids[lo + r] |= i
        return [
            pa.array(count),
            pa.array([_union(x) for x in found], pa.list_(pa.list_(pa.int64()))),
            pa.array([sorted(x) for x in ids], pa.list_(pa.string())),
        ]

    return append_columns(docs, text, fields, per_batch)


def _indices(docs: DataFrame, benchmark: DataFrame, size: int, text: str) -> Iterator[WindowIndex]:
    for part in _slices(benchmark, size):
        vocabulary = np.unique(np.frombuffer(b"".join(part["window"]), dtype=np.uint64))
        yield WindowIndex(part, word_counts(docs, vocabulary, text) if len(vocabulary) else {})


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def digest(df: DataFrame, n_words: str, spans: str, items: str, least: int = 20) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least one word in ``least`` is hit) to the hits; a name that is
    taken gets an underscore before it."""
    n_hit, n_items, sha, contaminated = fresh(df, "n_hit", "n_items", "items_sha256", "contaminated")
    joined = F.array_join(items, ",")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return (
        df.withColumn(n_hit, hit)
        .withColumn(n_items, F.size(items).cast("long"))
        .withColumn(sha, F.sha2(joined.cast("binary"), 256))
        .withColumn(contaminated, (F.col(n_hit) > 0) & (F.lit(least) * F.col(n_hit) >= F.col(n_words)))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13, least: int = 20, text: str = "text") -> DataFrame:
    """The documents of which less than one word in ``least`` lies in a benchmark window, with their own columns."""
    names = tuple(fresh(docs, "_n_words", "_spans", "_items"))
    found = find_hits(docs, benchmark, size, text, names)
    hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.filter((hit == 0) | (F.lit(least) * hit < F.col(names[0]))).select(*[F.col(f"`{c}`") for c in docs.columns])


def hashed_items(items: list[str]) -> str:
    """The digest of a list of item ids, as ``digest`` computes it."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
