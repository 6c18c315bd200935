"""Decontamination: exact phrases, n-gram overlap and vector similarity against evaluation sets.

The evaluation side is small next to the training side, but its size is not assumed: its n-grams are written, and
Spark broadcasts them if they are few. If not, only training n-grams that pass a broadcast set of fixed size are
shuffled. Training messages that match the same set of n-grams are folded into one signature before items are scored,
so copies and shared boilerplate cost one row.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatmill.functions import text as X
from chatmill.functions.arrays import indices, let
from chatmill.operators.metric_index import MetricIndex
from chatmill.operators.ordering import join_stats
from chatmill.operators.phrases import SLICE_TOKENS, scan
from chatmill.session import materialise

GRAM = ["g1", "g2"]  # two independent 64-bit hashes identify an n-gram
PLACES = 1 << 21  # of the set that thins grams before a join: some 50 MB when full
TILE = 4_000_000  # scores of vectors held at once, 32 MB
BROADCAST_BYTES = 256 << 20


def messages_to_docs(df: DataFrame, ids: str = "original_id", messages: str = "messages", role: str | None = "user") -> DataFrame:
    """One row per message of the role: (ids, msg, text)."""
    rows = df.select(ids, F.posexplode(messages).alias("msg", "m"))
    if role is not None:
        rows = rows.filter(F.col("m.role") == role)
    return rows.select(ids, "msg", F.col("m.content").alias("text"))


def eval_fields(evals: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """(item, field, tokens) for items whose fields are all present."""
    complete = evals.filter(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields]))
    rows = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f).alias("t")) for i, f in enumerate(fields)])
    return complete.select(F.col(item).alias("item"), F.explode(rows).alias("r")).select("item", "r.field", X.phrase_tokens(F.col("r.t")).alias("tokens"))


def _grams(tokens: Column, sizes: int | list[int]) -> Column:
    """array<struct<p, n, g1, g2>> of all token runs of the given sizes. Tokens are hashed once; a run is
    hashed from its token hashes."""
    sizes = [sizes] if isinstance(sizes, int) else sizes

    def build(h):
        def of(n):
            def one(i):
                return let(
                    F.slice(h, i + 1, F.lit(n)),
                    lambda run: F.struct(i.alias("p"), F.lit(n).alias("n"), F.xxhash64(run).alias("g1"), F.xxhash64(run, F.lit(1)).alias("g2")),
                )

            return F.transform(indices(F.size(h) - n + 1), one)

        return of(sizes[0]) if len(sizes) == 1 else F.concat(*[of(n) for n in sizes])

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), build)


def _join_grams(big: DataFrame, small: DataFrame) -> DataFrame:
    """Inner join on the gram. ``small`` is written, so Spark knows its size and broadcasts it when that is small.

    Before that ``big`` is thinned by the set of ``small``'s hashes modulo ``PLACES``, which has at most that many rows
    whatever the size of ``small``; so a ``small`` too large to broadcast moves the few grams that may match, not the
    grams of all texts.
    """
    small = materialise(small, "grams")
    places = F.broadcast(small.select(F.pmod("g1", F.lit(PLACES)).alias("_place")).distinct())
    thinned = big.join(places, F.pmod("g1", F.lit(PLACES)) == F.col("_place"), "left_semi")
    return thinned.join(small, GRAM)


def phrase_matches(docs: DataFrame, evals: DataFrame, ids: str, item: str, fields: list[str], shingle: int = 8) -> DataFrame:
    """(ids, msg, item) for every message that contains all fields of the item as token phrases.

    Items of a size that one automaton holds are found by it, inside the row (``phrases``). Of a larger set that goes for
    items with a field under ``shingle`` tokens, whose shingles would be frequent, in several automata; all other items are
    joined by their shingles. Null messages contain nothing; items with an empty field match nothing.
    """
    phrases = eval_fields(evals, item, fields).withColumn("len", F.size("tokens")).filter("len > 0").distinct()
    per_item = phrases.groupBy("item").agg(F.sum("len").alias("total"), F.min("len").alias("least"), F.countDistinct("field").alias("n"))
    short = (F.col("least") < shingle) & (F.col("n") == len(fields))
    size = per_item.agg(F.sum("total").alias("all"), F.sum(F.when(short, F.col("total"))).alias("short")).first()
    if (size["all"] or 0) <= SLICE_TOKENS:
        return scan(docs, phrases, ids, len(fields))
    found = _long_phrase_matches(docs, phrases.join(per_item.filter((F.col("least") >= shingle) & (F.col("n") == len(fields))), "item", "left_semi"), ids, len(fields), shingle)
    if not size["short"]:
        return found
    return found.unionByName(scan(docs, phrases.join(per_item.filter(short), "item", "left_semi"), ids, len(fields), -(-size["short"] // SLICE_TOKENS)))


def _long_phrase_matches(docs: DataFrame, phrases: DataFrame, ids: str, n_fields: int, k: int) -> DataFrame:
    """The same for phrases of ``k`` tokens or more: a phrase of L tokens is in a message exactly when its L-k+1 shingles
    match on one diagonal, that is at a constant distance between message and phrase position."""
    postings = phrases.select("item", "field", (F.col("len") - k + 1).alias("need"), F.explode(_grams(F.col("tokens"), k)).alias("g")).select(
        "item", "field", "need", F.col("g.p").alias("q"), "g.g1", "g.g2"
    )
    grams = docs.select(ids, "msg", F.explode(_grams(X.phrase_tokens(F.col("text")), k)).alias("g")).select(ids, "msg", "g.p", "g.g1", "g.g2")
    hits = _join_grams(grams, postings)
    diagonals = hits.groupBy(ids, "msg", "item", "field", (F.col("p") - F.col("q")).alias("d")).agg(F.count("*").alias("n"), F.first("need").alias("need"))
    found = diagonals.filter("n = need").select(ids, "msg", "item", "field")
    return (
        found.distinct()
        .groupBy(ids, "msg", "item")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == n_fields)
        .select(ids, "msg", "item")
    )


def exact_item_scores(matches: DataFrame, evals: DataFrame, item: str, fields: list[str]) -> DataFrame:
    """(item, score): 1 when some message matches, else 0; items with a null field are not scored."""
    scored = eval_fields(evals, item, fields).select("item").distinct()
    return scored.join(matches.select("item").distinct().withColumn("hit", F.lit(1)), "item", "left").select(
        "item", F.coalesce("hit", F.lit(0)).cast("double").alias("score")
    )


def covered_tokens(positions: Column, n: int) -> Column:
    """Number of token positions covered by n-grams that start at the given positions."""
    return F.aggregate(
        F.sort_array(positions),
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["total"] + p + n - F.greatest(a["end"], p)).alias("total"), (p + n).alias("end")),
        lambda a: a["total"],
    )


class NgramOverlap:
    """Scores of n-gram overlap between training messages and evaluation items.

    ``item_scores``: best score over messages, 0 when nothing is shared.
    ``train_scores``: best score over items, for training rows that share an n-gram.
    """

    def __init__(self, docs: DataFrame, evals: DataFrame, ids: str, item: str, fields: list[str], n: int = 8):
        self.ids = ids
        self.fields = eval_fields(evals, item, fields).withColumn("len", F.size("tokens"))
        # an n-gram repeated inside a field stands for its last position only
        postings = (
            self.fields.select("item", "field", "len", F.explode(_grams(F.col("tokens"), n)).alias("g"))
            .select("item", "field", "len", "g.p", "g.g1", "g.g2")
            .groupBy("item", "field", "len", *GRAM)
            .agg(F.max("p").alias("p"))
        )
        vocabulary = postings.select(*GRAM).distinct()
        grams = docs.select(ids, "msg", F.explode(_grams(X.phrase_tokens(F.col("text")), n)).alias("g")).select(ids, "msg", "g.g1", "g.g2")
        shared = _join_grams(grams, vocabulary)
        # written once: the only pass over the training texts, and only messages that share something remain
        self.units = materialise(
            shared.groupBy(ids, "msg")
            .agg(F.sort_array(F.collect_set(F.struct(*GRAM))).alias("grams"))
            .withColumn("sig", F.struct(F.xxhash64("grams").alias("a"), F.xxhash64("grams", F.lit(1)).alias("b"))),
            "overlap",
        )
        signatures = self.units.groupBy("sig").agg(F.first("grams").alias("grams"))
        per_field = (
            signatures.select("sig", F.explode("grams").alias("g"))
            .select("sig", "g.*")
        )
        per_field = (
            _join_grams(per_field, postings)
            .groupBy("sig", "item", "field", "len")
            .agg(F.collect_set("p").alias("at"))
        )
        pairs = per_field.groupBy("sig", "item").agg((F.sum(covered_tokens(F.col("at"), n) / F.col("len")) / len(fields)).alias("score"))
        self.pairs = pairs

    def item_scores(self) -> DataFrame:
        best = self.pairs.groupBy("item").agg(F.max("score").alias("score"))
        return self.fields.select("item").distinct().join(best, "item", "left").select("item", F.coalesce("score", F.lit(0.0)).alias("score"))

    def train_scores(self) -> DataFrame:
        best = self.pairs.groupBy("sig").agg(F.max("score").alias("score"))
        scored = join_stats(self.units.select(self.ids, "sig"), best, "sig")
        return scored.groupBy(self.ids).agg(F.max("score").alias("score"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, dtype=np.float64)
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(length == 0, 1.0, length)


def _top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best scores, ties to the lower id."""
    return np.lexsort((ids, -scores))[:k] if len(scores) <= 4 * k else _top_of_many(scores, ids, k)


def _top_of_many(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    keep = np.flatnonzero(scores >= floor)
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def nearest(train: DataFrame, queries: DataFrame, k: int = 5, train_id: str = "vec_id", item: str = "item", vector: str = "embedding",
            half_open: bool = False, broadcast_bytes: int = BROADCAST_BYTES, block_rows: int = 20_000) -> DataFrame:
    """Exact top-k training vectors per query by cosine: (item, train_id, score, rank).

    A query side proven to fit ``broadcast_bytes`` goes to every task, which keeps k candidates per
    query of its own rows; only those candidates are shuffled. A larger one searches a ``MetricIndex`` of the training
    vectors, which reads only the cells that may hold one of a query's k nearest.
    ``half_open`` maps cosine c to (1 + c) / 2.
    """
    spark = train.sparkSession
    train_type, item_type = train.schema[train_id].dataType, queries.schema[item].dataType
    schema = f"{item} {item_type.simpleString()}, {train_id} {train_type.simpleString()}, score double"
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).first()
    if size["n"] * size["d"] * 8 > broadcast_bytes:
        ranked = MetricIndex(train, train_id, vector, block_rows).search(queries, k, item, vector)[0]
        return ranked.withColumn("score", (1 + F.col("score")) / 2) if half_open else ranked

    def candidates(q_ids, q, t_ids, t):
        rows = max(1, TILE // max(1, len(t)))  # queries whose scores are held at once
        return pd.concat([tile(q_ids[i : i + rows], q[i : i + rows], t_ids, t) for i in range(0, len(q_ids), rows)], ignore_index=True)

    def tile(q_ids, q, t_ids, t):
        scores = q @ t.T
        best = [_top_rows(row, t_ids, k) for row in scores]
        return pd.DataFrame(
            {
                item: np.repeat(q_ids, [len(b) for b in best]),
                train_id: np.concatenate([t_ids[b] for b in best]),
                "score": np.concatenate([row[b] for row, b in zip(scores, best)]),
            }
        )

    def merge(frames):
        both = pd.concat(frames, ignore_index=True)
        return both.sort_values([item, "score", train_id], ascending=[True, False, True], kind="stable").groupby(item, sort=False).head(k)

    pdf = queries.select(item, vector).toPandas()  # size checked above
    shared = spark.sparkContext.broadcast((pdf[item].to_numpy(), _unit(np.stack(pdf[vector])) if len(pdf) else np.zeros((0, 1))))

    def scan(batches):
        q_ids, q = shared.value
        kept = None
        for b in batches:
            if len(b) and len(q_ids):
                new = candidates(q_ids, q, b[train_id].to_numpy(), _unit(np.stack(b[vector])))
                kept = new if kept is None else merge([kept, new])
        if kept is not None:
            yield kept

    found = train.select(train_id, vector).mapInPandas(scan, schema)
    best = Window.partitionBy(item).orderBy(F.col("score").desc(), train_id)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.withColumn("score", (1 + F.col("score")) / 2) if half_open else ranked


def vector_item_scores(hits: DataFrame, item: str = "item") -> DataFrame:
    return hits.groupBy(item).agg(F.max("score").alias("score"))


def vector_train_scores(hits: DataFrame, train_id: str = "vec_id") -> DataFrame:
    """Only the hits kept per query count for a training row."""
    return hits.groupBy(train_id).agg(F.max("score").alias("score"))


def contaminated(train_scores: DataFrame, ids: str, threshold: float) -> DataFrame:
    return train_scores.filter(F.col("score") > threshold).select(ids).distinct()


def union_ids(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def decontaminate(train: DataFrame, bad_ids: list[DataFrame], ids: str = "original_id") -> DataFrame:
    """Training rows that no evaluation set contaminates."""
    return train.join(union_ids([b.select(ids) for b in bad_ids]), ids, "left_anti")


def removal_report(train: DataFrame, kept: DataFrame) -> DataFrame:
    left = kept.agg(F.count("*").alias("kept")).scalar()
    return train.agg(F.count("*").alias("total")).withColumn("kept", left).select(
        "total", "kept", (F.col("total") - F.col("kept")).alias("removed"), (100.0 * F.col("kept") / F.col("total")).alias("kept_pct")
    )


def contamination_matrix(scores: DataFrame, train: str = "train_set", evaluation: str = "eval_set", evals: list[str] | None = None) -> DataFrame:
    """Mean item score, one row per training set and one column per evaluation set."""
    return scores.groupBy(train).pivot(evaluation, evals).agg(F.avg("score"))
