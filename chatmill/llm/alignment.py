"""Alignment of two tokenizers over a corpus: groups cut by common token ends, and how often ids are linked.

Both tokenizers run once over every text (``token_spans``); each row's links, one number for each pair of tokens that end
together, are written with its counts. The links are then counted: tasks send sums, not links. A document's figures need the
corpus-wide counts of its links. Pairs that make up more than one in ``HEAVY`` of all links are ``HEAVY`` at most by
arithmetic; they go to every task. All other pairs are rare, each with a bounded number of links, and are joined by id pair.
The best count of each B id is an array as long as B's vocabulary.

Null and empty texts, and texts that decoded tokens do not give back (a model that rewrites its input, a literal U+2581),
have no tokens: zeros and an empty digest. Texts are cut at bounded sizes where no token can cross, so a long text needs
memory by its tokens only. Repeated rows count as often as they occur, rows with a null id are rows like others, an empty
table gives no rows. Extra columns are kept; a new column whose name is taken gets an underscore before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.llm.common import fresh
from chatmill.llm.token_spans import BLOCK_BYTES, TokenizerPair, stretches, tokenizer_pair
from chatmill.session import materialise

TOKENIZERS = "/opt/tokenizers"
HEAVY = 500_000
FLUSH = 1_000_000  # distinct links that a task holds before it sends their sums
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def read_files(a_file: str, b_file: str) -> tuple[bytes, bytes]:
    """The two vocabulary files, some megabytes each."""
    with open(a_file, "rb") as a, open(b_file, "rb") as b:
        return a.read(), b.read()


class _Row:
    def __init__(self, with_groups: bool):
        self.n_a = self.n_b = 0
        self.fits, self.sha, self.links = True, hashlib.sha256(), []
        self.groups: list[bytes] | None = [] if with_groups else None

    def add(self, fits: bool, n_a: int, n_b: int, groups: bytes, links: np.ndarray) -> None:
        self.fits &= fits
        if not self.fits:
            return
        if self.n_a:
            groups = b";" + groups
        self.sha.update(groups)
        if self.groups is not None:
            self.groups.append(groups)
        self.n_a, self.n_b = self.n_a + n_a, self.n_b + n_b
        self.links.append(links)


def _blocks(pair: TokenizerPair, texts: list[bytes | None]) -> Iterator[list[tuple[int, bytes]]]:
    """(row, part of its text) in blocks of a bounded size."""
    block, size = [], 0
    for row, text in enumerate(texts):
        for part in pair.segments(text) if text else ():
            block.append((row, part))
            size += len(part)
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about a block of text, so that few rows' links are held at once."""
    upto = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + BLOCK_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _align_block(pair: TokenizerPair, block: list[tuple[int, bytes]], rows: dict[int, _Row], with_groups: bool) -> None:
    found, number, part = pair.distinct([p for _, p in block])
    n = found.n_links[number]
    links = found.links[stretches((np.cumsum(found.n_links) - found.n_links)[number], n)]
    cut = np.searchsorted(part, np.arange(len(block) + 1))
    ends = np.concatenate([[0], np.cumsum(n)])[cut]
    sums = [np.add.reduceat(x[number], cut[:-1]) for x in (found.n_a, found.n_b, (~found.fits).astype(np.int64))]
    every, upto = found.groups.tobytes(), np.cumsum(found.group_bytes).tolist()
    groups, numbers = [every[a:b] for a, b in zip([0, *upto], upto)], number.tolist()
    for k, (row, _) in enumerate(block):
        texts = b";".join([groups[i] for i in numbers[cut[k] : cut[k + 1]]])
        rows.setdefault(row, _Row(with_groups)).add(not sums[2][k], int(sums[0][k]), int(sums[1][k]), texts, links[ends[k] : ends[k + 1]])


def encode(docs: DataFrame, files: tuple[bytes, bytes], text: str = "text", names: tuple[str, ...] = ("n_a", "n_b", "n_groups", "groups_sha256", "links"), with_groups: bool = False) -> DataFrame:
    """``docs`` without the text, plus the number of tokens and groups, the digest of the groups and the packed links; with
    ``with_groups`` also the column ``groups``: ``a1,a2|b1;a3|b2`` with the ids of A and B in order."""
    shared = docs.sparkSession.sparkContext.broadcast(files)  # the size of the vocabulary files
    at = docs.columns.index(text)
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BinaryType()]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds)] + [T.StructField("groups", T.StringType())] * with_groups
    kept = [i for i in range(len(docs.columns)) if i != at]
    labels = [docs.columns[i] for i in kept] + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizer_pair(*shared.value)
        for batch in batches:
            for b in _slices(batch, at):
                rows: dict[int, _Row] = {}
                for block in _blocks(pair, b.column(at).cast(pa.large_binary()).to_pylist()):
                    _align_block(pair, block, rows, with_groups)
                out: list[list] = [[] for _ in fields]
                for i in range(b.num_rows):
                    r = rows.get(i)
                    r = r if r is not None and r.fits else None
                    links = np.concatenate(r.links) if r else np.zeros(0, dtype=np.int64)
                    made = [r.n_a if r else 0, r.n_b if r else 0, len(links), r.sha.hexdigest() if r else "", pack(links)]
                    for o, v in zip(out, [*made, *([b"".join(r.groups).decode() if r else ""] if with_groups else [])]):
                        o.append(v)
                arrow = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[pa.array(o, k) for o, k in zip(out, arrow)]], names=labels)

    return docs.mapInArrow(run, T.StructType([*[docs.schema.fields[i] for i in kept], *fields]))


def pack(links: np.ndarray) -> bytes:
    """The links in four or eight bytes each, compressed."""
    if not len(links):
        return b""
    return pa.compress(links.astype("<u4" if links.max() < 1 << 32 else "<i8").tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    raw = pa.input_stream(pa.BufferReader(packed), compression="zstd").read()
    return np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * n else "<i8").astype(np.int64)


def link_counts(encoded: DataFrame, links: str = "links", n_links: str = "n_groups") -> DataFrame:
    """(link, n): how often each pair of ids is linked in all rows. A task sums its links before it sends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for b in batches:
            for some in _unpacked(b, 2 << 20):
                new, n = np.unique(np.concatenate([x for _, x in some]), return_counts=True)
                both, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
                codes, sums = both, np.bincount(at, np.concatenate([sums, n]), len(both)).astype(np.int64)
                if len(codes) > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["link", "n"])
                    codes, sums = codes[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], names=["link", "n"])

    return encoded.select(links, n_links).mapInArrow(run, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def _unpacked(batch: pa.RecordBatch, limit: int, first: int = 0) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(row, links) in lists of a bounded number of links; columns ``first`` and the next are links and their number."""
    some, size = [], 0
    for i, (packed, n) in enumerate(zip(batch.column(first).to_pylist(), batch.column(first + 1).to_pylist())):
        if n:
            some.append((i, unpack(packed, n)))
            size += n
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


def align(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model", text: str = "text", names: tuple[str, ...] = NUMBERS, with_groups: bool = False) -> DataFrame:
    """``docs`` without the text, plus ``names``: tokens of A and of B, groups, links, links whose pair is the most frequent of
    its B id, the sum of the pairs' counts over the links, and the digest of the groups (and ``groups``, if asked for)."""
    spark: SparkSession = docs.sparkSession
    files = read_files(a_file, b_file)
    n_a, n_b, n_groups, n_links, n_best, count_sum, digest = fresh(docs, *names)
    links, row, rare, more_sum, more_best = fresh(docs, "_links", "_row", "_rare", "_more_sum", "_more_best")
    made = encode(docs, files, text, (n_a, n_b, n_groups, digest, links), with_groups)
    encoded = materialise(made.withColumn(row, F.monotonically_increasing_id()), "alignment-links")
    counts = materialise(link_counts(encoded, links, n_groups), "alignment-counts")
    b_size = tokenizer_pair(*files).b_size
    best = np.zeros(b_size, dtype=np.int64)
    for r in counts.groupBy((F.col("link") % b_size).alias("b")).agg(F.max("n").alias("n")).collect():  # B's vocabulary at most
        best[r["b"]] = r["n"]
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    heavy = counts.filter(F.col("n") * HEAVY > total).toPandas().sort_values("link")  # fewer than HEAVY rows by arithmetic
    top = spark.sparkContext.broadcast((heavy["link"].to_numpy(np.int64), heavy["n"].to_numpy(np.int64), best))
    others = [c for c in encoded.columns if c != links]
    at, keep = ([encoded.columns.index(c) for c in x] for x in ((links, n_groups), others))
    schema = T.StructType([*[encoded.schema[c] for c in others], *[T.StructField(c, T.LongType()) for c in (n_best, count_sum)], T.StructField(rare, T.ArrayType(T.LongType()))])

    labels = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n, of_b = top.value
        is_best = (n == of_b[codes % b_size]).astype(np.int64)
        for b in batches:
            bests, sums, left = np.zeros(b.num_rows, dtype=np.int64), np.zeros(b.num_rows, dtype=np.int64), [[]] * b.num_rows
            for some in _unpacked(pa.RecordBatch.from_arrays([b.column(i) for i in at], names=["l", "n"]), 2 << 20):
                x, back = np.unique(np.concatenate([y for _, y in some]), return_inverse=True)
                place = np.minimum(np.searchsorted(codes, x), max(len(codes) - 1, 0))
                known = codes[place] == x if len(codes) else np.zeros(len(x), dtype=bool)
                weight, good = np.where(known, n[place], 0) if len(codes) else known * 0, np.where(known, is_best[place], 0) if len(codes) else known * 0
                cut = np.cumsum([0, *[len(y) for _, y in some]])
                for k, (i, y) in enumerate(some):
                    here = back[cut[k] : cut[k + 1]]
                    sums[i], bests[i] = weight[here].sum(), good[here].sum()
                    left[i] = y[~known[here]]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in keep], pa.array(bests), pa.array(sums), pa.array([list(x) for x in left], pa.list_(pa.int64()))],
                names=labels,
            )

    known = materialise(encoded.mapInArrow(run, schema), "alignment-known")
    of_b = spark.createDataFrame([(i, int(v)) for i, v in enumerate(best) if v], "_b long, _best long")  # B's vocabulary at most
    few = counts.filter(F.col("n") * HEAVY <= total).join(F.broadcast(of_b), F.col("link") % b_size == F.col("_b"))
    loose = known.filter(F.size(rare) > 0).select(row, F.explode(rare).alias("_link"))
    more = (
        loose.join(few, F.col("_link") == F.col("link"))
        .groupBy(row)
        .agg(F.sum("n").alias(more_sum), F.sum((F.col("n") == F.col("_best")).cast("long")).alias(more_best))
        .withColumnRenamed(row, f"{row}_r")
    )
    joined = known.join(more, F.col(row) == F.col(f"{row}_r"), "left")
    return (
        joined.withColumn(n_best, F.col(n_best) + F.coalesce(more_best, F.lit(0)))
        .withColumn(count_sum, F.col(count_sum) + F.coalesce(more_sum, F.lit(0)))
        .withColumn(n_links, F.col(n_groups))  # tokens have bytes, so each common end links one token of A to one of B
        .drop(row, f"{row}_r", rare, more_sum, more_best)
    )
