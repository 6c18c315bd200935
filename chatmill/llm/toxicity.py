"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Fitting (on a bounded sample of labelled rows, ``max_rows``, two thirds for counts and one for calibration): tokens get the
log-odds between toxic and clean texts under an informative Dirichlet prior (their pooled frequency times ``prior`` of
the sample's size); those whose z-score (under the stronger prior ``z_prior``) and log-odds are large enough are kept,
``max_tokens`` at most. Tokens are words and stems (the first bytes of longer words); a word that the model does not
know counts as its stem. Every word pays ``drift``, so the expected score of clean text is negative. Scoring: one linear scan finds all maximal scoring segments of a text
(no segment can be extended or shortened with gain). A segment of score S in n tokens has the expected number of equals
E = K n exp(-lambda S) in clean text (lambda solves sum p exp(lambda s) = 1 over clean tokens, K is the maximum-likelihood
value over clean calibration texts); segments with E below ``significance`` are the toxic passages. Their -log E are
added up and a logistic curve fitted on the calibration part turns the sum into a probability.

Null, empty and wordless texts have no segment and the lowest score. With fewer than two classes in the labels nothing
is learned and every score is the share of label 1 (0 without labels). Ties cannot change the set of segments; repeated
rows are scored one by one. Clashing extra columns are kept, working names avoid them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import ALNUM, LOWER, append_columns, blocks, bounded_labels, class_counts, fresh, mix64, one_text_each, words, words_of_rows

MAX_ROWS = 8000
TABLE_BITS = 18
STEM_BYTES, STEMMED_BYTES = 4, 6


def tokens_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word hash, stem hash) of each word; a short word is its own stem."""
    data = LOWER[data]
    starts, ends, hashes = words(data, ALNUM)
    stems = hashes.copy()
    at = np.flatnonzero(ends - starts >= STEMMED_BYTES)
    packed = np.full(len(at), 0x5354454D, dtype=np.uint64)
    for i in range(STEM_BYTES):
        packed = (packed << np.uint64(8)) | data[starts[at] + i]
    stems[at] = mix64(packed)
    return starts, ends, hashes, stems


@dataclass
class SegmentModel:
    tokens: np.ndarray  # sorted hashes
    scores: np.ndarray
    drift: float
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    intercept: float = 0.0
    significance: float = 0.05

    def __post_init__(self):
        self.maybe = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.maybe[self.tokens >> np.uint64(64 - TABLE_BITS)] = True

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.flatnonzero(self.maybe[hashes >> np.uint64(64 - TABLE_BITS)])
        if not len(self.tokens) or not len(near):
            return near[:0], near[:0]
        at = np.minimum(np.searchsorted(self.tokens, hashes[near]), len(self.tokens) - 1)
        found = self.tokens[at] == hashes[near]
        return near[found], at[found]

    def known(self, hashes: np.ndarray, stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the model knows by themselves or by their stem, and their indices in it."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        for keys in (stems, hashes):  # the word itself goes last and wins
            at, index = self._known(keys)
            out[at] = index
        at = np.flatnonzero(out >= 0)
        return at, out[at]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * np.log1p(evidence), -500, 500)))


def maximal_segments(positions: list[int], scores: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a text in which every token costs ``drift`` and the tokens at
    ``positions`` add ``scores``. Each candidate is pushed and merged once: linear in the number of listed tokens."""
    stack: list[list] = []  # start, end, sum before it, sum after it, index of the nearest candidate with a smaller sum before
    total, last = 0.0, 0
    for p, s in zip(positions, scores):
        total -= drift * (p - last)
        last = p
        before, total = total, total + s - drift
        last += 1
        if s <= drift:
            continue
        new = [p, p + 1, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _rows(texts: pa.Array, model: SegmentModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row with a known token: (row, words, word offset of the row, known positions, model indices, byte starts)."""
    for lo, _, data, offsets in blocks(texts):
        starts, ends, hashes, stems = tokens_of(data)
        at = words_of_rows(starts, offsets)
        known, index = model.known(hashes, stems)
        cut = np.searchsorted(known, at)
        for r in range(len(at) - 1):
            span = slice(cut[r], cut[r + 1])
            yield lo + r, int(at[r + 1] - at[r]), known[span] - at[r], index[span], starts[at[r] : at[r + 1]] - offsets[r], ends[at[r] : at[r + 1]] - offsets[r]


def _counts(sample: DataFrame, text: str) -> DataFrame:
    """(token, toxic, clean): texts of the sample that hold the token, summed per block before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.array(b.column(1).to_pylist(), dtype=np.int64)
            for lo, _, data, offsets in blocks(b.column(0)):
                starts, _, hashes, stems = tokens_of(data)
                at = words_of_rows(starts, offsets)
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                longer = stems != hashes
                tokens, index = np.unique(np.concatenate([hashes, stems[longer]]), return_inverse=True)
                once = np.unique(index * (len(at) - 1) + np.concatenate([row, row[longer]]))  # each token counts once in a text
                index, toxic = once // (len(at) - 1), label[lo + once % (len(at) - 1)]
                n1 = np.bincount(index, weights=toxic, minlength=len(tokens)).astype(np.int64)
                n = np.bincount(index, minlength=len(tokens))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["token", "toxic", "clean"])

    return sample.select(text, "label").mapInArrow(run, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", max_rows: int = MAX_ROWS, prior: float = 0.01, z_prior: float = 0.1, least_z: float = 3.5, least_odds: float = 1.0, max_tokens: int = 20_000, drift: float = 0.1, significance: float = 0.05, seed: int = 17) -> SegmentModel:
    """Model from labelled documents. The sample is bounded by ``max_rows``; the prior share of the classes is counted over all labels."""
    n0, n1 = class_counts(labels, label)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    none = SegmentModel(np.zeros(0, dtype=np.uint64), np.zeros(0), drift, slope=0.0, intercept=math.log(share / (1 - share)) if 0 < share < 1 else (40.0 if share else -40.0))
    if not n0 or not n1:
        return none
    ids = bounded_labels(labels, label, max_rows, seed)
    # equal texts count once: a group of copies must not pass for evidence on its words
    sample = one_text_each(docs.select("doc_id", text).join(F.broadcast(ids), "doc_id"), text).withColumn("_key", F.xxhash64(text)).dropDuplicates(["_key", "label"])
    for_counts, for_curve = (sample.filter(F.pmod(F.col("_key"), F.lit(3)).isin(*k)) for k in ((0, 1), (2,)))
    tokens = _counts(for_counts, text)
    sums = tokens.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    y1, y0 = sums["toxic"] or 0, sums["clean"] or 0
    if not y0 or not y1:
        return none
    share_of_all = (F.col("toxic") + F.col("clean")) / (y0 + y1)

    def odds(strength: float) -> tuple[Column, Column]:
        weight = strength * (y0 + y1)
        one, zero = F.col("toxic") + weight * share_of_all, F.col("clean") + weight * share_of_all
        value = F.log(one / (y1 + weight)) - F.log(zero / (y0 + weight))
        return value, value / F.sqrt(1 / one + 1 / zero)

    kept = (
        tokens.select("token", odds(prior)[0].alias("odds"), odds(z_prior)[1].alias("z")).filter((F.abs("z") >= least_z) & (F.abs("odds") >= least_odds))
        .orderBy(F.abs("z").desc(), "token").limit(max_tokens).toPandas().sort_values("token", key=lambda s: s.to_numpy().view(np.uint64))
    )
    model = SegmentModel(kept["token"].to_numpy(dtype=np.int64).view(np.uint64), kept["odds"].to_numpy(dtype=float), drift, significance=significance)
    _calibrate(model, for_curve, text, share)
    return model


def _calibrate(model: SegmentModel, sample: DataFrame, text: str, share: float) -> None:
    """Sets lambda, K and the logistic curve from the calibration part: at most ``max_rows`` rows of four numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, out = b.column(1).to_pylist(), []
            for r, n, pos, idx, _, _ in _rows(b.column(0), model):
                segments = maximal_segments(pos.tolist(), model.scores[idx].tolist(), model.drift)
                out.append((label[r], n, idx.astype(np.int32).tolist(), [s for _, _, s in segments]))
            yield pa.RecordBatch.from_pylist([dict(zip(("label", "n", "known", "segments"), x)) for x in out], schema=pa.schema([("label", pa.int32()), ("n", pa.int64()), ("known", pa.list_(pa.int32())), ("segments", pa.list_(pa.float64()))]))

    mapped = sample.select(text, "label").mapInArrow(run, "label int, n long, known array<int>, segments array<double>")
    known = mapped.filter("label = 0").select(F.explode("known").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toPandas()
    rows = mapped.drop("known").toPandas()
    clean = rows[rows["label"] == 0]
    total = float(clean["n"].sum())
    if not len(clean) or not total:
        return
    p = np.append(known["n"].to_numpy(dtype=float), max(total - known["n"].sum(), 1.0)) / total
    s = np.append(model.scores[known["t"].to_numpy(dtype=int)], 0.0) - model.drift
    model.lam = _solve_lambda(p, s)
    best = np.array([max(x, default=0.0) for x in clean["segments"]])
    model.k = len(clean) / float((np.maximum(clean["n"], 1) * np.exp(-model.lam * best)).sum())
    x = np.log1p([evidence(model, n, [(0, 0, v) for v in seg]) for n, seg in zip(rows["n"], rows["segments"])])
    model.slope, model.intercept = _logistic(x, rows["label"].to_numpy(dtype=float), share)


def _solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 0.5 to 2 at least and at most, as the sample may lack rare positive scores."""
    lo, hi = 0.5, 2.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if float((p * np.exp(np.minimum(mid * s, 600))).sum()) > 1:
            hi = mid
        else:
            lo = mid
    return (lo + hi) / 2


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak ridge; the sample's classes are weighted back to their share."""
    w = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    a = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (w * (q - y)) + 1e-3 * beta
        hess = (a * (w * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2)
        beta -= np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(beta[0]), float(beta[1])


def evidence(model: SegmentModel, n: int, segments: list[tuple[int, int, float]]) -> float:
    """Sum of -log E over the significant segments."""
    base = math.log(model.k * max(n, 1))
    return sum(max(0.0, model.lam * s - base) for _, _, s in segments if model.lam * s - base >= -math.log(model.significance))


def score(docs: DataFrame, model: SegmentModel, text: str = "text", names: tuple[str, ...] = ("score", "passages")) -> DataFrame:
    """``docs`` plus the probability of label 1 and the passages: array of (start byte, end byte, score, expected number)."""
    names = tuple(fresh(docs, *names))
    passage = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])
    fields = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.ArrayType(passage))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_tokens hashes and scores at most
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def per_batch(texts: pa.Array) -> list[pa.Array]:
        m = shared.value
        sums, found = np.zeros(len(texts)), [[] for _ in range(len(texts))]
        for r, n, pos, idx, starts, ends in _rows(texts, m):
            if not len(pos):
                continue
            segments = maximal_segments(pos.tolist(), m.scores[idx].tolist(), m.drift)
            sums[r] = evidence(m, n, segments)
            for a, b, s in segments:
                e = m.k * n * math.exp(-m.lam * s)
                if e <= m.significance:
                    found[r].append({"start": int(starts[a]), "end": int(ends[b - 1]), "score": s, "expected": e})
        return [pa.array(m.probability(sums)), pa.array(found, arrow)]

    return append_columns(docs, text, fields, per_batch)


def drop_toxic(docs: DataFrame, model: SegmentModel, limit: float = 0.7, text: str = "text") -> DataFrame:
    """The documents that score below ``limit``, with their own columns."""
    names = tuple(fresh(docs, "_score", "_passages"))
    return score(docs, model, text, names).filter(F.col(names[0]) < limit).select(*[F.col(f"`{c}`") for c in docs.columns])
