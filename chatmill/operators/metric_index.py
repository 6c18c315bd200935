"""Exact nearest vectors of many queries among many vectors, through an index of pivots, rings and blocks.

Every vector belongs to its nearest pivot's cell and, by its distance to that pivot, to a ring of the cell. A ring is
written with its number of rows and its smallest and largest distance; one with more than ``block_rows`` rows is dealt to
several blocks of that size, so equal vectors by the million are many blocks. The triangle inequality bounds how near a
ring can come to a query, and the plane halfway between two pivots bounds it again; rings whose bound lies beyond the k
vectors already known are not read. What is known comes first from the rings' counts alone, then from a probe of at
most k blocks nearby.

The rings a query may need are counted where its bounds are, one row a query. They are read as blocks of about ``block_rows``
rows, neighbouring rings together, so a query is copied once for each block that holds a ring of its, not for each ring: where
bounds exclude nothing, as among vectors without clusters, every query meets every block. A block is read with at most about
``query_rows`` of the queries that visit it, so both sides of every task are bounded, and a block is copied only as often as its
visitors need. Nothing is approximate: bounds are loosened by more than the error of their arithmetic, and the score of a hit
is computed row by row, so equal vectors tie wherever they are read.

Vectors are compared by cosine, as points of the unit sphere. A zero vector has cosine 0 with every other, as a direction
of its own. Rows with a null id, and vectors that are null, of another length than the longest or hold a null or non-finite
component take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.session import materialise

RINGS = 32  # of a cell, by distance from 0 to 2
MAX_PIVOTS = 2048
PIVOT_BYTES = 64 << 20  # pivots go to every task
TILE = 4_000_000  # scores or bounds held at once, 32 MB
HEAD = 2048  # rows of a block whose k best bound those of the rest
FEW = 100  # rows near a query's best that are compared together with those of other queries
SLACK = 1e-6  # of distances; that of scores is its square


def usable(vector: str, size: int) -> Column:
    return (F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def directions(column: pa.Array, size: int, side: int) -> np.ndarray:
    """Unit vectors with two more components, which tell zero vectors of the two sides apart."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    top = np.abs(v).max(axis=1, keepdims=True) if size else np.zeros((len(v), 1))
    v = v / np.where(top == 0, 1.0, top)  # first, so that squares neither overflow nor vanish
    v = v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    return np.hstack([v, np.where(top == 0, np.eye(2)[[side]], 0.0)])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def _vectors(array: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(array.ravel()), array.shape[1]).cast(pa.list_(pa.float64()))


def nearest_rings(worst: np.ndarray, k: int) -> np.ndarray:
    """The first k places of a stable sort of every row."""
    k = min(k, worst.shape[1])
    row, which = np.nonzero(worst <= np.partition(worst, k - 1, axis=1)[:, k - 1 : k])
    which = which[np.lexsort((worst[row, which], row))]
    sizes = np.bincount(row, minlength=len(worst))
    return which[(np.cumsum(sizes) - sizes)[:, None] + np.arange(k)]


def best_rows(scores: np.ndarray, q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best vectors of ``t`` for the query ``q``, ties to the lower id; ``scores`` are approximate."""
    floor = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) > k else scores.min()
    near = np.flatnonzero(scores >= floor - 1e-9)
    exact = (t[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -exact))[:k]
    return near[order], exact[order]


def best_of_tile(scores: np.ndarray, floor: np.ndarray, q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, rows, scores) of each query's k best vectors of ``t`` that are not under its floor; ``scores`` are approximate."""
    head = min(len(t), max(HEAD, k))
    low = floor if head < k else np.maximum(floor, np.partition(scores[:, :head], head - k, axis=1)[:, head - k])
    near = scores >= low[:, None] - 1e-9
    sizes = near.sum(axis=1)
    many = np.flatnonzero(sizes > FEW)
    near[many] = False
    who, which = np.nonzero(near)
    exact = (t[which] * q[who]).sum(axis=1)
    order = np.lexsort((ids[which], -exact, who))
    who, which, exact = who[order], which[order], exact[order]
    sizes[many] = 0
    first = np.arange(len(who)) - (np.cumsum(sizes) - sizes)[who] < k
    parts = [(who[first], which[first], exact[first])]
    for i in many.tolist():
        rows, exact = best_rows(scores[i], q[i], t, ids, k)
        parts.append((np.full(len(rows), i), rows, exact))
    who, which, exact = (np.concatenate(x) for x in zip(*parts))
    keep = exact >= floor[who] - 1e-9
    return who[keep], which[keep], exact[keep]


class MetricIndex:
    """The written index of ``train``; ``search`` finds the nearest vectors of any number of queries."""

    def __init__(self, train: DataFrame, ids: str = "vec_id", vector: str = "embedding", block_rows: int = 20_000, query_rows: int = 20_000, pivots: int | None = None):
        self.spark, self.ids, self.block_rows, self.query_rows = train.sparkSession, ids, block_rows, query_rows
        self.id_type = train.schema[ids].dataType
        self.size = size = train.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).first()["d"]
        rows = train.select(F.col(ids).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable("v", size))
        self.rows = n = rows.count()
        most = max(1, min(pivots or int(2 * n**0.5) + 1, MAX_PIVOTS, PIVOT_BYTES // (8 * (size + 2))))
        sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(most).select("v").toArrow()  # at most PIVOT_BYTES
        self.pivots = np.unique(directions(sample.column("v"), size, 0), axis=0) if n else np.zeros((0, size + 2))
        centres = self.spark.sparkContext.broadcast(self.pivots)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p = centres.value
            step = max(1, TILE // max(len(p), 1))
            for b in batches:
                for lo in range(0, b.num_rows, step):
                    part = b.slice(lo, step)
                    u = directions(part.column(1), size, 0)
                    cell = np.argmax(u @ p.T, axis=1)
                    far = np.sqrt(((u - p[cell]) ** 2).sum(axis=1))
                    ring = cell * RINGS + np.minimum((far * (RINGS / 2)).astype(np.int64), RINGS - 1)
                    yield pa.RecordBatch.from_arrays([part.column(0), _vectors(u), pa.array(ring), pa.array(far)], names=["id", "u", "ring", "far"])

        kind = self.id_type.simpleString()
        placed = rows.mapInArrow(assign, f"id {kind}, u array<double>, ring long, far double")
        table = materialise(placed.withColumn("row", F.monotonically_increasing_id()), "metric-index")
        stats = table.groupBy("ring").agg(F.count("*").alias("n"), F.min("far").alias("lo"), F.max("far").alias("hi")).orderBy("ring").toArrow()  # RINGS for each pivot at most
        self.ring, self.n, self.lo, self.hi = (stats.column(c).to_numpy() for c in ("ring", "n", "lo", "hi"))
        self.salts = -(-self.n // block_rows)
        salted = F.broadcast(self.spark.createDataFrame([(int(r), int(s)) for r, s in zip(self.ring, self.salts) if s > 1], "_ring long, _salts long"))
        self.blocks = (
            table.join(salted, F.col("ring") == F.col("_ring"), "left")
            .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("_salts")), F.lit(0)))
            .drop("_ring", "_salts", "row", "far")
        )
        # neighbouring rings up to block_rows rows are one run, read as one block; a ring of several blocks is a run of its own
        self.run_start, self.run_salts, held = [], [], 0
        for i, (rows_in, salts) in enumerate(zip(self.n.tolist(), self.salts.tolist())):
            if not i or salts > 1 or self.run_salts[-1] > 1 or held + rows_in > block_rows:
                self.run_start.append(i)
                self.run_salts.append(salts)
                held = 0
            held += rows_in

    def search(self, queries: DataFrame, k: int = 5, item: str = "item", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
        """The k nearest vectors of every item, (item, id, score, rank), and what was read for each query: (item, rings_read, rows_read)."""
        kind, item_kind = self.id_type.simpleString(), queries.schema[item].dataType.simpleString()
        hit = f"item {item_kind}, id {kind}, score double"
        if not self.rows:
            none = self.spark.createDataFrame([], f"{hit}, rank int").withColumnsRenamed({"item": item, "id": self.ids})
            return none, self.spark.createDataFrame([], f"item {item_kind}, rings_read long, rows_read long").withColumnRenamed("item", item)
        valid = queries.select(F.col(item).alias("item"), F.col(vector).cast("array<double>").alias("v")).filter(usable("v", self.size))
        q = materialise(valid.withColumn("q", F.monotonically_increasing_id()).withColumn("floor", F.lit(-2.0)), "metric-queries")
        probe = self._scored(materialise(self._probed(q, k), "metric-probe"), k, item_kind, self.blocks, ["ring", "salt"])
        best = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))  # of k blocks with k scores each
        known = probe.groupBy("q").agg(F.coalesce(best, F.lit(-2.0)).alias("_floor"))
        q = q.join(known, "q", "left").withColumn("floor", F.coalesce("_floor", "floor")).select("item", "v", "q", "floor")
        visits = materialise(self._reached(q, k), "metric-visits")
        run = np.repeat(np.arange(len(self.run_start)), np.diff([*self.run_start, len(self.ring)]))
        first = np.cumsum([0, *self.run_salts])[run]
        place = F.broadcast(self.spark.createDataFrame([(int(r), int(x)) for r, x in zip(self.ring, first)], "ring long, _first long"))
        blocks = self.blocks.join(place, "ring").withColumn("block", F.col("_first") + F.col("salt")).select("id", "u", "block")
        found = self._scored(visits.select("item", "q", "u", "floor", F.explode("blocks").alias("block")), k, item_kind, blocks, ["block"])
        by_rank = Window.partitionBy("item").orderBy(F.col("score").desc(), "id")
        hits = found.select("item", "id", "score", F.row_number().over(by_rank).alias("rank")).filter(F.col("rank") <= k)
        reads = visits.select("item", "rings_read", "rows_read")
        return hits.withColumnsRenamed({"item": item, "id": self.ids}), reads.withColumnRenamed("item", item)

    def _bounds(self):
        """A function of a batch of queries: parts of it with their unit vectors, each ring's least distance, the nearest rings by
        their greatest distance, how many of these hold less than k rows, and those distances."""
        shared = self.spark.sparkContext.broadcast((self.pivots, self.ring, self.n, self.lo, self.hi))
        size = self.size

        def bounds(b: pa.RecordBatch, k: int) -> Iterator[tuple]:
            p, ring, n, lo, hi = shared.value
            cell = ring // RINGS
            between = 2.0 - 2.0 * (p @ p.T)  # squared distances of pivots
            step = max(1, TILE // max(len(ring), len(p)))
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                u = directions(part.column(1), size, 1)
                far = _distances(u, p)
                home = far.argmin(axis=1)
                own = far[np.arange(len(u)), home]
                gap = np.sqrt(np.maximum(between[home], 1e-12))
                plane = np.where(between[home] > 1e-9, (far**2 - (own**2)[:, None]) / (2.0 * gap), 0.0)  # to the plane halfway between two pivots
                far_cell = far[:, cell]
                near = np.maximum(np.maximum(far_cell - hi, lo - far_cell), plane[:, cell])
                worst = far_cell + hi
                order = nearest_rings(worst, k)
                enough = (np.cumsum(n[order], axis=1) < k).sum(axis=1)  # so many rings and one more hold k rows
                yield at, part, u, near, worst, order, enough

        return bounds

    def _probed(self, q: DataFrame, k: int) -> DataFrame:
        """(item, q, u, floor, ring, salt): at most k blocks near a query, a row for each."""
        shared = self.spark.sparkContext.broadcast((self.ring, self.salts))
        bounds = self._bounds()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ring, salts = shared.value
            for b in batches:
                for at, part, u, _, _, order, enough in bounds(b, k):
                    counts = np.minimum(enough + 1, len(ring))
                    row = np.repeat(np.arange(len(u)), counts)
                    which = order[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)]
                    salt = (row + at) % salts[which]
                    index = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(index), part.column(2).take(index), _vectors(u[row]), part.column(3).take(index), pa.array(ring[which]), pa.array(salt.astype(np.int64))],
                        names=["item", "q", "u", "floor", "ring", "salt"],
                    )

        item_kind = q.schema["item"].dataType.simpleString()
        return q.select("item", "v", "q", "floor").mapInArrow(run, f"item {item_kind}, q long, u array<double>, floor double, ring long, salt long")

    def _reached(self, q: DataFrame, k: int) -> DataFrame:
        """(item, q, u, floor, rings_read, rows_read, blocks): the rings that may hold one of a query's k nearest, the rows in them
        and the blocks they are in, a row for each query."""
        shared = self.spark.sparkContext.broadcast((len(self.ring), self.n, np.array(self.run_start), np.repeat(np.arange(len(self.run_start)), self.run_salts)))
        bounds = self._bounds()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rings, n, starts, run_of_block = shared.value
            for b in batches:
                for _, part, u, near, worst, order, enough in bounds(b, k):
                    reach = np.where(enough < rings, np.take_along_axis(worst, np.minimum(order_at(order, enough), rings - 1), axis=1)[:, 0], 2.0)
                    score = part.column(3).to_numpy(zero_copy_only=False)
                    reach = np.minimum(reach, np.sqrt(np.maximum(2.0 - 2.0 * score, 0.0)))
                    read = near <= (reach + SLACK)[:, None]
                    held = np.logical_or.reduceat(read, starts, axis=1)[:, run_of_block]
                    offsets = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                    blocks = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.nonzero(held)[1].astype(np.int64)))
                    rows = read @ n.astype(float)  # whole numbers
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(2), _vectors(u), part.column(3), pa.array(read.sum(axis=1).astype(np.int64)), pa.array(rows.astype(np.int64)), blocks],
                        names=["item", "q", "u", "floor", "rings_read", "rows_read", "blocks"],
                    )

        item_kind = q.schema["item"].dataType.simpleString()
        return q.select("item", "v", "q", "floor").mapInArrow(run, f"item {item_kind}, q long, u array<double>, floor double, rings_read long, rows_read long, blocks array<long>")

    def _scored(self, visits: DataFrame, k: int, item_kind: str, blocks: DataFrame, key: list[str]) -> DataFrame:
        """(item, q, id, score): the k best of every block for each query that reads it, not under the query's floor."""
        size = self.size + 2
        crowds = materialise(visits.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(self.query_rows)).alias("chunks")), "metric-crowds")  # a row for each block
        left = blocks.join(crowds, key).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
        right = visits.select("item", "q", "u", "floor", *key).join(crowds, key).withColumn("chunk", F.pmod(F.xxhash64("q"), F.col("chunks"))).drop("chunks")
        schema = f"item {item_kind}, q long, id {self.id_type.simpleString()}, score double"

        def run(block: pa.Table, asked: pa.Table) -> pa.Table:
            names = ["item", "q", "id", "score"]
            if not block.num_rows or not asked.num_rows:
                return pa.table([asked.column("item").slice(0, 0), asked.column("q").slice(0, 0), block.column("id").slice(0, 0), pa.array([], pa.float64())], names=names)
            t = block.column("u").combine_chunks().flatten().to_numpy().reshape(-1, size)
            u = asked.column("u").combine_chunks().flatten().to_numpy().reshape(-1, size)
            ids, floor = block.column("id").to_numpy(), asked.column("floor").to_numpy()
            who, which, score = [], [], []
            step = max(1, TILE // len(t))
            for lo in range(0, len(u), step):
                some = slice(lo, lo + step)
                rows = best_of_tile(u[some] @ t.T, floor[some], u[some], t, ids, k)
                who.append(rows[0] + lo)
                which.append(rows[1])
                score.append(rows[2])
            who, which = (pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (who, which))
            return pa.table([asked.column("item").take(who), asked.column("q").take(who), block.column("id").take(which), pa.array(np.concatenate(score) if score else np.zeros(0))], names=names)

        return left.groupBy(*key, "chunk").cogroup(right.groupBy(*key, "chunk")).applyInArrow(run, schema)


def order_at(order: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The column that each row's order has at a place (the last one for places beyond)."""
    return np.take_along_axis(order, np.minimum(place, order.shape[1] - 1)[:, None], axis=1)
