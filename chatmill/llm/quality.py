"""Quality classifier: supervised subword embeddings.

Features of a text are hashed words (runs of bytes that are not white space), hashed pairs of neighbouring words, and
hashed byte 3- and 4-grams inside words. A pair's hash is the exclusive or of its words' hashes: the order of the two does
not count, and all pairs of a word with itself have one hash, so that a learned vector can stand for repetition whatever the
word. (With pairs hashed in order, only repetitions of words seen in training can be learned.) Each feature has a learned
vector; a text is the average of its features' vectors and a softmax over two classes reads it. Vectors and output are
trained by numpy stochastic gradient descent on a bounded sample (``max_rows`` labelled rows, half of each class, whole
texts). Since the average is linear, scoring needs one number per feature.

Null, empty and blank texts have no feature and score by the intercept alone. With fewer than two classes in the labels
every score is the share of label 1 (0 without labels). Repeated rows are scored one by one. Extra columns are kept; where one
is named as the score, the score's name gets an underscore.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import NOT_SPACE, append_columns, blocks, bounded_labels, class_counts, fresh, one_text_each, words

MAX_ROWS = 3000
BUCKET_BITS = 16
GRAMS = (3, 4)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(32)).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(byte position, bucket) of the words, of the pairs of neighbours in a row, and of the byte n-grams of each length."""
    shift = np.uint32(32 - BUCKET_BITS)
    starts, _, hashes = words(data, NOT_SPACE)
    yield starts, _bucket(hashes)
    same_row = np.diff(np.searchsorted(offsets, starts, "right")) == 0
    yield starts[1:][same_row], _bucket((hashes[1:] ^ hashes[:-1])[same_row])
    inside, wide = NOT_SPACE[data], data.astype(np.uint32)
    run, rolling = inside.copy(), wide * np.uint32(0x85EBCA6B)
    for n in range(2, max(GRAMS) + 1):
        run = run[:-1] & inside[n - 1 :]
        rolling = (rolling[:-1] ^ (rolling[:-1] >> np.uint32(15))) * np.uint32(0x9E3779B1) + wide[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in GRAMS:
            at = np.flatnonzero(run)
            yield at, ((rolling[at] ^ np.uint32(n * 0x1000193)) * np.uint32(2654435761)) >> shift


@dataclass
class SubwordModel:
    weights: np.ndarray  # log-odds that a feature adds, one per bucket
    intercept: float

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for lo, hi, data, offsets in blocks(texts):
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for at, bucket in features(data, offsets):
                cut = np.searchsorted(at, offsets)
                sums = np.concatenate([[0.0], np.cumsum(self.weights[bucket], dtype=np.float64)])
                total += sums[cut[1:]] - sums[cut[:-1]]
                count += np.diff(cut)
            out[lo:hi] = total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.intercept, -500, 500)))


def _sample_features(sample: DataFrame, text: str) -> DataFrame:
    """(key, label, buckets, shares): a text's distinct buckets as int32 and their shares as float32 bytes, 2^BUCKET_BITS at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, shares = [], []
            for _, _, data, offsets in blocks(b.column(2)):
                parts = list(features(data, offsets))
                cuts = [np.searchsorted(at, offsets) for at, _ in parts]
                for r in range(len(offsets) - 1):
                    own = np.concatenate([f[c[r] : c[r + 1]] for (_, f), c in zip(parts, cuts)])
                    ids, n = np.unique(own, return_counts=True)
                    buckets.append(ids.astype(np.int32).tobytes())
                    shares.append((n / max(n.sum(), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(buckets, pa.binary()), pa.array(shares, pa.binary())], names=["key", "label", "buckets", "shares"])

    return sample.select(F.xxhash64(text).alias("key"), "label", text).mapInArrow(run, "key long, label int, buckets binary, shares binary")


def fit(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", max_rows: int = MAX_ROWS, dim: int = 16, epochs: int = 5, rate: float = 0.1, seed: int = 5) -> SubwordModel:
    """Model from labelled documents. The sample is bounded by ``max_rows``; the classes' shares are counted over all labels."""
    n0, n1 = class_counts(labels, label)
    share = n1 / (n0 + n1) if n0 + n1 else 0.0
    if not n0 or not n1:
        return SubwordModel(np.zeros(1 << BUCKET_BITS, dtype=np.float32), 40.0 if share else -40.0)
    sample = one_text_each(docs.select("doc_id", text).join(F.broadcast(bounded_labels(labels, label, max_rows, seed)), "doc_id"), text)
    rows = _sample_features(sample, text).toPandas().drop_duplicates(["key", "label"]).sort_values(["key", "label"])
    examples = [(np.frombuffer(b, np.int32), np.frombuffer(s, np.float32), y) for b, s, y in zip(rows["buckets"], rows["shares"], rows["label"])]
    examples = [x for x in examples if len(x[0])]
    weights, bias = train(examples, dim, epochs, rate, seed)
    seen = sum(y for _, _, y in examples)
    shift = math.log(share / (1 - share)) - math.log(max(seen, 1) / max(len(examples) - seen, 1))  # the sample is balanced, the corpus is not
    return SubwordModel(weights, bias + shift)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """(log-odds per bucket, bias) by stochastic gradient descent, one text a step, at a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << BUCKET_BITS, dim)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (dim, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, shares, y = examples[k]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            mean = shares @ vectors[ids]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= now * np.outer(mean, p)
            bias -= now * p
            # shares of a feature are small numbers: the vectors move at a rate that does not shrink with the text's length
            vectors[ids] -= (now * np.sqrt(len(ids))) * shares[:, None] * back[None, :]
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def score(docs: DataFrame, model: SubwordModel, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` plus the probability of label 1 (under a changed name if ``docs`` has one like it)."""
    (name,) = fresh(docs, name)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BUCKET_BITS numbers
    return append_columns(docs, text, [T.StructField(name, T.DoubleType())], lambda texts: [pa.array(shared.value.score(texts))])
