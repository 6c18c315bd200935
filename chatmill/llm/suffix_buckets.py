"""Removal of repeated byte strings by bucket-pointer refinement.

Every string of ``length`` (100) bytes that also starts earlier (smaller doc_id, or same document) is covered and removed.

Bucket identifiers are built as in bucket-pointer refinement: a position's bucket for 2n bytes is the pair of the
n-byte buckets at the position and at offset n, so the identifiers of 1, 2, 4 ... 32 bytes are reused recursively and
96 + 4 make 100. Initial buckets are the 32-grams; as every 100-byte string holds 69 of them, it is filed under the one
with the smallest identifier, its anchor, and the neighbouring strings with the same anchor form one block. Buckets that
hold one block are settled. The others are refined by the identifiers of the offsets around the anchor, which cover the
whole block: equal blocks are settled at once, all but the first being repeats. Only blocks that share an anchor but are
not all equal are refined down to single strings.

Documents are dealt to pages, ranges of doc_id of about equal bytes, written once as a table bucketed by page. In each
of the three rounds a page sends its sorted distinct identifiers, as packed differences, to the identifier's bucket
task; that task answers, in the same order, how often each occurs and whether an earlier page has it. An identifier is
sent once per page however often it occurs there, so copies and common passages do not gather in a task, and no
position is ever shuffled as a row. Identifiers have 64 bits (48 for anchors, where a collision only costs work).

Null text is empty; texts under ``length`` bytes keep everything; a text may be of any length (it is scanned in pieces).
Rows that share a doc_id are ordered by text. Null ids come after all others, in pages by hash of their text. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatmill.llm.common import mix64
from chatmill.session import materialise, shared_dir

LENGTH, GRAM = 100, 32
PIECE = 1 << 18  # starts scanned at once
PAGE_BYTES = (4 << 20, 64 << 20)
PAGES = 20_000
ANCHOR_BITS = 48
STEP = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.uint64(29)
LETTERS = mix64(np.arange(1, 257, dtype=np.uint64))
ROW = pa.schema([("page", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
ROW_DDL = "page int, bucket int, a binary, b binary"


def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifiers of the pairs."""
    out = left * STEP
    out += right
    out ^= out >> FOLD
    return out


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 4-grams and of the 32-grams at every position."""
    ids, n, four = LETTERS[data], 1, None
    while n < GRAM:
        ids = join(ids[:-n], ids[n:])
        n *= 2
        if n == 4:
            four = ids
    return four, ids


def hundred(four: np.ndarray, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of the 100-byte strings at the given positions, from those of later offsets."""
    return join(join(join(grams[at], grams[at + 32]), grams[at + 64]), four[at + 96])


def anchors(grams: np.ndarray, starts: int) -> np.ndarray:
    """For each start, the place of the smallest identifier among its 69 grams; the first one of equals."""
    low = np.uint64((1 << 20) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    reach, span = 1, LENGTH - GRAM + 1
    while reach * 2 <= span:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
    return (best[:starts] & low).astype(np.int64)


def blocks_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
    """(anchor identifiers, block identifiers as a function, first start, number of starts) per piece of a page.

    ``offsets`` are those of the documents, each followed by a separator that belongs to no string.
    """
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    lens = np.diff(offsets) - 1
    long = lens >= LENGTH
    inside[offsets[:-1][long]] += 1
    inside[offsets[:-1][long] + lens[long] - LENGTH + 1] -= 1
    valid = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    for lo in range(0, len(data), PIECE):
        hi = min(lo + PIECE, len(data) - LENGTH + 1)
        starts = np.flatnonzero(valid[lo:hi]) if hi > lo else ()
        if not len(starts):
            continue
        four, grams = identifiers(data[lo : hi + LENGTH - 1])
        anchor = anchors(grams, hi - lo)[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        heads = np.flatnonzero(new)
        first, anchor, count = starts[heads], anchor[heads], np.diff(np.append(heads, len(starts)))

        def whole(keep: np.ndarray, four=four, grams=grams, first=first, anchor=anchor, count=count) -> np.ndarray:
            """The first and last string cover the block; the anchor's offset and the count fix its shape."""
            s, n = first[keep], count[keep]
            shape = (anchor[keep] - s).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)
            return mix64(join(join(hundred(four, grams, s), hundred(four, grams, s + n - 1)), shape))

        # anchors have small identifiers, mixing spreads them over the bucket tasks
        yield mix64(grams[anchor]) >> np.uint64(64 - ANCHOR_BITS), whole, lo + first, count


def strings_of(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, identifier) of every string of the given blocks."""
    out_s, out_k = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
    for lo in range(0, len(first), 1024):
        f, n = first[lo : lo + 1024], count[lo : lo + 1024].astype(np.int64)
        width = n + LENGTH - 1
        ends = np.cumsum(width)
        within = np.arange(ends[-1]) - np.repeat(ends - width, width)
        four, grams = identifiers(data[np.repeat(f, width) + within])
        at = np.repeat(ends - width, n) + (k := np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        out_k.append(hundred(four, grams, at))
        out_s.append(np.repeat(f, n) + k)
    return np.concatenate(out_s), np.concatenate(out_k)


# --- packed, sorted identifiers -------------------------------------------------------------------


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct identifiers as differences of as few bytes as the largest one needs."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(steps[1:].max() if len(steps) > 1 else 0).bit_length() // 8))
    return bytes([width]) + keys[:1].tobytes() + steps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    width = raw[0]
    steps = np.zeros(((len(raw) - 9) // width + 1, 8), dtype=np.uint8)
    steps[0] = np.frombuffer(raw, np.uint8, 8, 1)
    steps[1:, :width] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts above one with their places: most are one."""
    at = np.flatnonzero(counts != 1)
    return at.astype(np.uint32).tobytes() + counts[at].astype(np.uint32).tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out, half = np.ones(n, dtype=np.int64), len(raw) // 2
    out[np.frombuffer(raw[:half], np.uint32)] = np.frombuffer(raw[half:], np.uint32)
    return out


def letters_to(page: int, keys: np.ndarray, counts: np.ndarray, bits: int, top: int) -> list[tuple]:
    """A page's rows for the bucket tasks. ``top``: bits of the identifiers."""
    cut = np.searchsorted(keys >> np.uint64(top - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return [(page, b, pack(keys[x:y]), pack_counts(counts[x:y])) for b, (x, y) in enumerate(zip(cut[:-1], cut[1:])) if y > x]


def answer(t: pa.Table) -> pa.Table:
    """A bucket task: total count of each identifier, and whether a page before has it, to each page in its own order."""
    pages = t.column("page").to_pylist()
    keys = [unpack(x) for x in t.column("a").to_pylist()]
    counts = [unpack_counts(x, len(k)) for x, k in zip(t.column("b").to_pylist(), keys)]
    every, index = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(index, weights=np.concatenate(counts)).astype(np.int64)
    earliest = np.full(len(every), np.iinfo(np.int32).max, dtype=np.int32)
    np.minimum.at(earliest, index, np.repeat(np.array(pages, dtype=np.int32), [len(k) for k in keys]))
    cut = np.cumsum([0, *[len(k) for k in keys]])
    rows = []
    for i, p in enumerate(pages):
        own = index[cut[i] : cut[i + 1]]
        rows.append({"page": p, "bucket": t.column("bucket")[i].as_py(), "a": pack_counts(total[own]), "b": len(own).to_bytes(4, "little") + np.packbits(earliest[own] < p).tobytes()})
    return pa.Table.from_pylist(rows, schema=ROW)


def answered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(total counts, seen earlier) of a page's identifiers, in their order."""
    total, seen = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=bool)]
    rows = sorted(zip(t.column("bucket").to_pylist(), t.column("a").to_pylist(), t.column("b").to_pylist()))
    for bucket, a, b in rows:
        if bucket >= 0:
            n = int.from_bytes(b[:4], "little")
            total.append(unpack_counts(a, n))
            seen.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=4), count=n).astype(bool))
    return np.concatenate(total), np.concatenate(seen)


# --- pages -----------------------------------------------------------------------------------------


def page_bytes(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """(rows in order, bytes, offsets) of a page."""
    t = t.sort_by([("id", "ascending"), ("text", "ascending")])
    raw = t.column("text").combine_chunks().to_pylist()
    offsets = np.cumsum([0, *[len(x) + 1 for x in raw]])
    return t, np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8), offsets


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct, index of each key, counts, whether a key is not the first of its kind)."""
    every, first, index, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    again = np.ones(len(keys), dtype=bool)
    again[first] = False
    return every, index, counts, again


def page_blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
    parts = list(blocks_of(data, offsets))
    return np.concatenate([np.zeros(0, dtype=np.uint64), *[p[0] for p in parts]]), parts


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_pylist([dict(zip(ROW.names, r)) for r in rows], schema=ROW)


def dump(*arrays: np.ndarray) -> bytes:
    return b"".join(len(x.tobytes()).to_bytes(8, "little") + x.tobytes() for x in arrays)


def load(raw: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for k in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw[at + 8 : at + 8 + n], dtype=k))
        at += 8 + n
    return out


def kept_state(t: pa.Table) -> bytes | None:
    """The state that a page has left for its next round."""
    return next((a for b, a in zip(t.column("bucket").to_pylist(), t.column("a").to_pylist()) if b < 0), None)


def send_anchors(bits: int):
    def run(t: pa.Table) -> pa.Table:
        _, data, offsets = page_bytes(t)
        keys, counts = np.unique(page_blocks(data, offsets)[0], return_counts=True)
        return table_of(letters_to(t.column("page")[0].as_py(), keys, counts, bits, ANCHOR_BITS))

    return run


def send_blocks(bits: int):
    """Blocks in buckets that hold more than one: their identifiers, and the page's state (start, strings, index, bucket size)."""

    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return table_of([])
        page = t.column("page")[0].as_py()
        _, data, offsets = page_bytes(t)
        anchor, parts = page_blocks(data, offsets)
        if not len(anchor):
            return table_of([])
        total, _ = answered(replies)
        size = total[np.unique(anchor, return_inverse=True)[1]]
        cut = np.cumsum([0, *[len(p[0]) for p in parts]])
        keep = [np.flatnonzero(size[a:b] > 1) for a, b in zip(cut, cut[1:])]
        keys = np.concatenate([p[1](k) for p, k in zip(parts, keep)])
        every, index, counts, _ = distinct(keys)
        state = dump(
            np.concatenate([p[2][k] for p, k in zip(parts, keep)]).astype(np.int32), np.concatenate([p[3][k] for p, k in zip(parts, keep)]).astype(np.uint8),
            index.astype(np.int32), size[size > 1].astype(np.uint32),
        )
        return table_of([*letters_to(page, every, counts, bits, 64), (page, -1, state, None)])

    return run


def send_strings(bits: int):
    """Settles equal blocks; the first block of each kind in a mixed bucket sends its strings. State: repeated blocks, mixed blocks."""

    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        state = kept_state(replies)
        if state is None or not t.num_rows:
            return table_of([])
        page = t.column("page")[0].as_py()
        first, count, index, size = load(state, "<i4", "u1", "<i4", "<u4")
        total, seen = answered(replies)
        _, _, _, again = distinct(index)
        again |= seen[index]
        mixed = ~again & (total[index] != size)
        _, data, _ = page_bytes(t)
        _, keys = strings_of(data, first[mixed].astype(np.int64), count[mixed])
        every, _, counts, _ = distinct(keys)
        left = dump(first[again], count[again], first[mixed], count[mixed])
        return table_of([*letters_to(page, every, counts, bits, 64), (page, -1, left, None)])

    return run


def finish(with_bytes: bool):
    def run(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.Table.from_pylist([], schema=out_schema(with_bytes))
        t, data, offsets = page_bytes(t)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        state = kept_state(replies)
        if state is not None:
            first, count, mixed, strings = load(state, "<i4", "u1", "<i4", "u1")
            _, seen = answered(replies)
            starts, keys = strings_of(data, mixed.astype(np.int64), strings)
            _, where, _, again = distinct(keys)
            starts = starts[again | seen[where]]
            np.add.at(change, first, 1)
            np.add.at(change, first + count.astype(np.int64) - 1 + LENGTH, -1)
            np.add.at(change, starts, 1)
            np.add.at(change, starts + LENGTH, -1)
        gone = np.cumsum(change[:-1], dtype=np.int32) > 0
        edge = np.concatenate([[0], np.cumsum(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1)])
        total = np.concatenate([[0], np.cumsum(gone)])
        a, b = offsets[:-1], offsets[1:] - 1
        kept = [data[x:y].tobytes() if not n else data[x:y][~gone[x:y]].tobytes() for x, y, n in zip(a, b, total[b] - total[a])]
        columns = [
            t.column("doc_id").combine_chunks(), pa.array(b - a, pa.int64()), pa.array(total[b] - total[a], pa.int64()), pa.array(edge[b] - edge[a], pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), *([pa.array(kept, pa.binary())] if with_bytes else []),
        ]
        return pa.Table.from_arrays(columns, schema=out_schema(with_bytes))

    return run


def out_schema(with_bytes: bool) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.binary())] if with_bytes else [])])


def paged(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(table bucketed by page: doc_id, id, page, text as bytes; bits of the bucket tasks). Ranges follow a bounded sample weighted by bytes."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    size = F.length("text") + 1
    total = source.agg(F.sum(size).alias("n")).first()["n"] or 0
    wanted = min(max(total // PAGES, PAGE_BYTES[0]), PAGE_BYTES[1])
    n = max(1, int(total // wanted))
    step = max(1, total // (n * 32))  # one sampled row per so many bytes
    chance = F.pmod(F.xxhash64(F.lit("page"), "doc_id"), F.lit(step)) < size
    rows = source.filter(F.col("doc_id").isNotNull() & chance).select("doc_id", F.greatest(size, F.lit(step)).alias("w")).toPandas().sort_values("doc_id")
    sums = rows["w"].cumsum().to_numpy()
    ends = sorted({int(rows["doc_id"].iloc[min(np.searchsorted(sums, sums[-1] * k / n), len(rows) - 1)]) for k in range(1, n)}) if len(rows) else []
    limits = spark.sparkContext.broadcast(np.array(ends, dtype=np.int64))  # PAGES numbers or, beyond, one per 64 MB

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            page = np.searchsorted(limits.value, ids.fill_null(0).to_numpy(zero_copy_only=False), "left").astype(np.int32)
            null = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            for r in null:
                page[r] = len(limits.value) + 1 + int.from_bytes(hashlib.sha256(texts[r].as_py()).digest()[:4], "big") % max(n, 1)
            yield pa.RecordBatch.from_arrays([ids, pa.array(page), ids.fill_null((1 << 63) - 1), texts], names=["doc_id", "page", "id", "text"])

    dealt = source.mapInArrow(deal, "doc_id long, page int, id long, text binary")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(n, 4096))
    name = f"pages_{uuid.uuid4().hex}"
    dealt.repartition(tasks, "page").write.bucketBy(tasks, "page").option("path", f"{shared_dir(spark).rstrip('/')}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name), min(12, max(3, (n - 1).bit_length()))


def remove_repeats(docs: DataFrame, text: str = "text", with_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_bytes``, kept) of every document."""
    pages, bits = paged(docs, text)

    def asked(rows: DataFrame) -> DataFrame:
        return rows.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer, ROW_DDL)

    def round_(rows: DataFrame, fn, ddl: str) -> DataFrame:
        return pages.groupBy("page").cogroup(rows.groupBy("page")).applyInArrow(fn, ddl)

    first = pages.groupBy("page").applyInArrow(send_anchors(bits), ROW_DDL)
    sent = materialise(round_(asked(first), send_blocks(bits), ROW_DDL), "blocks")
    sent = materialise(round_(asked(sent).unionByName(sent.filter("bucket < 0")), send_strings(bits), ROW_DDL), "strings")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_bytes else "")
    return round_(asked(sent).unionByName(sent.filter("bucket < 0")), finish(with_bytes), ddl)
