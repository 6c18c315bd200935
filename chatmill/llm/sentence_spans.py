"""Substring removal by sliding sentence spans.

A sentence ends at a line break, or at white space after ".", "!" or "?". These runs of consecutive sentences are hashed
(ASCII case and white space do not count): from every sentence on, and up to every sentence, the shortest run of at least
``run`` sentences and ``least_words`` words; every sentence of ``long_words`` words; and a text that is shorter than any
run, as a whole. Equal runs are joined over all documents, and all but the first (smallest doc_id, then smallest place)
mark their sentences for removal. So each sentence of a repeated passage that is long enough is inside a repeated run, and
a copy of a document loses all. The first occurrence of a sentence always stays.

Null and empty texts have no sentence. Rows that share doc_id and text are one document: a run that comes first there
stays in each of them; other rows of one doc_id are ordered by a hash of their text. Null ids come last and are one id. Extra columns are kept in ``remove``;
clashing names are avoided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import LOWER, MULTIPLIER, NOT_SPACE, append_columns, blocks, fresh, mix64, words
from chatmill.session import materialise

LAST_ID = (1 << 63) - 1
STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?"])


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, hash, words, n + 1 offsets of the rows' sentences). A sentence reaches to the next one's start."""
    starts, ends, hashes = words(LOWER[data], NOT_SPACE)
    if not len(starts):
        return starts, hashes, starts, np.zeros(len(offsets), dtype=np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    new_line = breaks[starts[1:]] > breaks[ends[:-1]]
    first = np.concatenate([[True], new_line | STOPS[data[ends[:-1] - 1]]])
    first[np.searchsorted(starts, offsets[:-1][np.searchsorted(starts, offsets[:-1]) < len(starts)])] = True
    heads = np.flatnonzero(first)
    lens = np.diff(np.append(heads, len(starts)))
    place = np.arange(len(starts)) - np.repeat(heads, lens)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lens.max()) + 1, MULTIPLIER, dtype=np.uint64))
        own = mix64(np.add.reduceat(hashes * powers[place], heads) + lens.astype(np.uint64))
    return starts[heads], own, lens, np.searchsorted(starts[heads], offsets)


def runs(own: np.ndarray, lens: np.ndarray, rows: np.ndarray, run: int, least_words: int, long_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, sentences, hash) of the runs inside rows; no run has more than max(run, least_words) sentences."""
    n = len(own)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    at, total = np.arange(n), np.concatenate([[0], np.cumsum(lens)])
    stop = np.maximum(at + run, np.searchsorted(total, total[:-1] + least_words))
    start = np.minimum(at + 1 - run, np.searchsorted(total, total[1:] - least_words, "right") - 1)
    onward, back, alone = stop <= rows[row + 1], start >= rows[row], lens >= long_words
    short = np.flatnonzero((np.diff(rows) > 0) & ((np.diff(rows) < run) | (total[rows[1:]] - total[rows[:-1]] < least_words)))
    starts = np.concatenate([at[onward], start[back], at[alone], rows[short]])
    stops = np.concatenate([stop[onward], at[back] + 1, at[alone] + 1, rows[short + 1]])
    starts, sizes = np.divmod(np.unique(starts * (n + 1) + stops - starts), n + 1)
    hashed = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(int(sizes.max(initial=0))):
            more = np.flatnonzero(sizes > i)
            hashed[more] = mix64(hashed[more] * MULTIPLIER + own[starts[more] + i])
    return row[starts], starts - rows[row[starts]], sizes, hashed


def spans(docs: DataFrame, run: int, least_words: int, long_words: int, text: str = "text") -> DataFrame:
    """(span, id, version, place) of every run in every document; the version tells texts of one id apart, the place holds
    the first sentence's number in its upper half and the number of sentences in its lower half."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, versions = b.column(0).to_numpy(), b.column(2).to_numpy()
            for lo, _, data, offsets in blocks(b.column(1)):
                _, own, lens, rows = sentences(data, offsets)
                row, place, size, hashed = runs(own, lens, rows, run, least_words, long_words)
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64)), pa.array(ids[lo + row]), pa.array(versions[lo + row]), pa.array(place << 32 | size)], names=["span", "id", "version", "place"])

    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id")
    return docs.select(key, text, F.xxhash64(text).alias("version")).mapInArrow(emit, "span long, id long, version long, place long")


def repeated_places(docs: DataFrame, run: int, least_words: int, long_words: int, text: str = "text") -> DataFrame:
    """(id, version, places): sorted places of the non-first runs of each document that has any."""
    every = spans(docs, run, least_words, long_words, text)
    first = every.groupBy("span").agg(F.count("*").alias("n"), F.min(F.struct("id", "version", "place")).alias("first")).filter("n > 1")
    shared = materialise(first.select("span", "first"), "spans").withColumnRenamed("span", "_span")
    later = every.join(shared, F.col("span") == F.col("_span")).filter(F.struct("id", "version", "place") != F.col("first"))
    return later.groupBy("id", "version").agg(F.sort_array(F.collect_set("place")).alias("places"))  # a document's own sentences


def remove(docs: DataFrame, run: int = 2, least_words: int = 8, text: str = "text", names: tuple[str, ...] = ("n_sentences", "n_removed", "n_removed_words", "kept_text"), long_words: int = 25) -> DataFrame:
    """``docs`` plus: sentences, those removed, their words, and the text that is left (null stays null)."""
    names = tuple(fresh(docs, *names))
    key, version, other, its, places = fresh(docs, "_key", "_version", "_id", "_its", "_places")
    marked = repeated_places(docs, run, least_words, long_words, text).select(F.col("id").alias(other), F.col("version").alias(its), F.col("places").alias(places))
    keyed = docs.withColumns({key: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), version: F.xxhash64(text)})
    joined = keyed.join(marked, (F.col(key) == F.col(other)) & (F.col(version) == F.col(its)), "left").drop(key, other, version, its)
    pair = F.struct(F.col(text).alias("t"), F.col(places).alias("p"))
    both = fresh(joined, "_both")[0]
    fields = [T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.LongType()), T.StructField(names[3], T.StringType())]

    def per_batch(column: pa.Array) -> list[pa.Array]:
        texts, marks = column.field("t"), column.field("p").to_pylist()
        n, gone, words_gone, out = [], [], [], []
        for lo, hi, data, offsets in blocks(texts):
            starts, _, lens, rows = sentences(data, offsets)
            for r in range(hi - lo):
                a, b = rows[r], rows[r + 1]
                place, size = np.divmod(np.asarray(marks[lo + r] or [], dtype=np.int64), 1 << 32)
                drop = np.cumsum(np.bincount(place, minlength=b - a + 1) - np.bincount(place + size, minlength=b - a + 1))[:-1] > 0
                n.append(int(b - a))
                gone.append(int(drop.sum()))
                words_gone.append(int(lens[a:b][drop].sum()))
                if not drop.any():
                    out.append(texts[lo + r].as_py())
                    continue
                edges = np.concatenate([[offsets[r]], starts[a + 1 : b], [offsets[r + 1] - 1]])  # leading blanks go with the first sentence
                out.append(b"".join(data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~drop)).decode())
        return [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(words_gone, pa.int64()), pa.array(out, pa.string())]

    return append_columns(joined.withColumn(both, pair).drop(places), both, fields, per_batch).drop(both)
