"""Nearest neighbours by cosine through randomly rotated one-bit codes.

Unit vectors are rotated by one random orthogonal matrix; a code keeps the signs (packed bits) and one correction
scalar f = <o, sign(o) / sqrt(D)>. For a query q, <code, q> / f estimates the cosine without bias, and differs from it
by more than sqrt((1 - f^2) / f^2) * epsilon / sqrt(D - 1) only with a probability that falls as exp(-c epsilon^2). A
scan reads codes; a vector is compared exactly, on the original numbers, only if its upper bound reaches the k-th best
of what the task has seen. Each task returns k rows per query, which are merged.

All rows are coded and all are scanned for every query; queries go to the tasks in blocks of bounded size. Vectors that
are null, zero, or hold null or non-finite numbers take no part, nor do rows without an id. Vectors are compared with
those of the same length only, and scaled by a power of two first, so that squares neither overflow nor vanish. Each row
is a query or candidate of its own: only the query's own row is left out, and a query id with several rows has as many
lists. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.session import materialise

QUERY_BYTES = 16 << 20
TILE = 256  # queries
PAIRS = 16_384  # exact comparisons at once
EPSILON = 3.0


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vector: Column) -> Column:
    """No null, no non-finite number, not all zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(v, lambda x: x != 0.0), F.lit(False))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield rows, flat.reshape(len(rows), int(n))


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 3) -> DataFrame:
    """(vec_id, embedding, code, correction, norm) of every usable row; vectors are scaled to a largest component in [1, 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes, factor, norm = [b""] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            scaled: list = [None] * b.num_rows
            for rows, v in _by_length(b.column(1)):
                exponent = np.frexp(np.abs(v).max(axis=1, keepdims=True))[1] - 1
                v = np.ldexp(np.ldexp(v, -(exponent // 2)), -(exponent - exponent // 2))  # exact, in two steps of half the size
                norm[rows] = norms(v)
                turned = (v / norm[rows][:, None]) @ rotation(v.shape[1], seed).T
                for r, x in zip(rows.tolist(), v):
                    scaled[r] = x
                factor[rows] = np.abs(turned).sum(axis=1) / np.sqrt(v.shape[1])
                for r, bits in zip(rows.tolist(), np.packbits(turned > 0, axis=1)):
                    codes[r] = bits.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scaled, pa.list_(pa.float64())), pa.array(codes, pa.binary()), pa.array(factor), pa.array(norm)], names=["vec_id", "embedding", "code", "correction", "norm"])

    source = vectors.filter(usable(F.col(vector)) & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("embedding"))
    return source.mapInArrow(run, "vec_id long, embedding array<double>, code binary, correction double, norm double")


class Best:
    """The k best candidates of each query so far: by score, then by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.vec = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def limit(self, q: slice) -> np.ndarray:
        return self.score[q, -1]

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        touched = np.unique(query)
        q = np.concatenate([query, np.repeat(touched, self.k)])
        s = np.concatenate([score, self.score[touched].ravel()])
        v = np.concatenate([vec, self.vec[touched].ravel()])
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        first = np.searchsorted(q, touched)
        take = (first[:, None] + np.arange(self.k)).ravel()
        self.score[touched], self.vec[touched] = s[take].reshape(-1, self.k), v[take].reshape(-1, self.k)


def _scan(queries: dict[int, tuple[np.ndarray, np.ndarray]], k: int, seed: int, epsilon: float):
    """The task: queries are (rows, ids, vectors) by length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {n: Best(len(ids), k) for n, (_, ids, _) in queries.value.items()}
        prepared = {n: (own, v, norms(v)) for n, (own, _, v) in queries.value.items()}
        turned = {n: ((v / size[:, None]) @ rotation(n, seed).T) for n, (_, v, size) in prepared.items()}
        for b in batches:
            if not b.num_rows:
                continue
            lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for n in np.unique(lengths):
                if int(n) in state:
                    rows = np.flatnonzero(lengths == n)
                    _scan_rows(b.take(pa.array(rows)), prepared[int(n)], turned[int(n)], state[int(n)], epsilon)
        for n, best in state.items():
            q, j = np.nonzero(best.score > -np.inf)
            own, ids, _ = queries.value[n]
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[q]), pa.array(best.vec[q, j]), pa.array(best.score[q, j])], names=["query_row", "query_id", "vec_id", "score"])

    return run


def _scan_rows(b: pa.RecordBatch, query: tuple, turned: np.ndarray, best: Best, epsilon: float) -> None:
    own, vectors, lengths = query
    n = vectors.shape[1]
    vec, row = b.column("vec_id").to_numpy(), b.column("row").to_numpy()
    f, norm = b.column("correction").to_numpy(), b.column("norm").to_numpy()
    bits = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(len(vec), -1)
    signs = np.unpackbits(bits, axis=1, count=n).astype(np.float32) * 2 - 1
    candidates = b.column("embedding").flatten().to_numpy().reshape(len(vec), n)
    error = (epsilon / np.sqrt(max(n - 1, 1)) * np.sqrt(np.maximum(1 - f * f, 0)) / f).astype(np.float32)
    scale = (1 / (f * np.sqrt(n))).astype(np.float32)
    for lo in range(0, len(own), TILE):
        q = slice(lo, lo + TILE)
        estimate = (turned[q].astype(np.float32) @ signs.T) * scale
        estimate[own[q][:, None] == row[None, :]] = -np.inf
        floor = best.limit(q)
        if len(vec) > best.k:  # the k-th best lower bound of this batch will do as well
            sure = np.partition(estimate - error, len(vec) - best.k, axis=1)[:, len(vec) - best.k]
            floor = np.maximum(floor, sure - 1e-5)
        qi, ci = np.nonzero(estimate + error >= (floor - 1e-5)[:, None])
        keep = np.isfinite(estimate[qi, ci])
        qi, ci = qi[keep], ci[keep]
        for at in range(0, len(qi), PAIRS):
            a, c = qi[at : at + PAIRS] + lo, ci[at : at + PAIRS]
            score = (vectors[a] * candidates[c]).sum(axis=1) / (lengths[a] * norm[c])
            best.add(a, score, vec[c])


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 3, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query row, over all rows."""
    spark = vectors.sparkSession
    codes = materialise(encode(vectors, vec_id, vector, seed).withColumn("row", F.monotonically_increasing_id()), "codes")
    asked = codes.filter(is_query).select("row", "vec_id", "embedding")
    total = asked.agg(F.sum(F.size("embedding") * 8 + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // QUERY_BYTES))
    found = None
    for i in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == i).toPandas()
        by_length = {int(n): (g["row"].to_numpy(), g["vec_id"].to_numpy(), np.stack(g["embedding"].to_numpy()).astype(np.float64)) for n, g in rows.groupby(rows["embedding"].map(len))}
        part = codes.mapInArrow(_scan(spark.sparkContext.broadcast(by_length), k, seed, epsilon), "query_row long, query_id long, vec_id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
