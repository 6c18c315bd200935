"""Two tokenizers on the same bytes: where their tokens end, and the groups that their common ends cut.

A is a file for ``tokenizers``, whose spans are characters; B is a sentencepiece model, whose spans come with its proto. Both
are read as byte offsets in ``space + text``. A span end that no neighbour shares is a coarse cut and is taken as it is;
tokens that end inside a character, and runs of byte-fallback tokens, are placed from the cut before them by the lengths
of their decoded bytes.

A text is encoded in chunks: it is cut where neither tokenizer can have a token across. A cuts before a single space or line
feed between other characters, and between a letter or digit and a punctuation mark. B has no token across if none of its
pieces holds such a pair of bytes, which is read off the vocabulary; a mark for which it does not hold is no cut, and a
model that rewrites texts is never cut. Chunks repeat, so their results are kept in a cache of bounded size; new chunks of
a block are joined and encoded together.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator
from itertools import chain
from operator import attrgetter
from typing import NamedTuple

import numpy as np

from chatmill.llm.common import MULTIPLIER, mix64

BLOCK_BYTES = 512 << 10  # of text worked on at once
JOINED_BYTES = 16 << 10  # new chunks that are encoded in one call
LONG_CHUNK = 512  # longer ones are encoded alone and not kept
KEPT_CHUNKS = 400_000  # some 40 MB
UNDERLINE = "▁".encode()
GUARD = b" a"
ID_AND_END = attrgetter("id", "end")


class Entry(NamedTuple):
    """A chunk's tokens: counts, groups as text and one link (A id times B's size plus B id) for each group."""

    fits: bool
    n_a: int
    n_b: int
    groups: bytes
    links: bytes  # eight for each


UNFIT = Entry(False, 0, 0, b"", b"")


class Found(NamedTuple):
    """The same for many chunks: arrays, and the texts and links of all of them one after the other."""

    fits: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    groups: np.ndarray  # bytes
    group_bytes: np.ndarray  # of each chunk
    links: np.ndarray
    n_links: np.ndarray

    @staticmethod
    def of(entries: list[Entry]) -> Found:
        links = np.frombuffer(b"".join([e.links for e in entries]), dtype="<i8")
        groups = np.frombuffer(b"".join([e.groups for e in entries]), dtype=np.uint8)
        columns = [np.array([e[i] for e in entries], dtype=bool if i == 0 else np.int64) for i in range(3)]
        sizes = [np.array([len(e[i]) for e in entries], dtype=np.int64) for i in (3, 4)]
        return Found(*columns, groups, sizes[0], links, sizes[1] // 8)

    def take(self, at: np.ndarray) -> Found:
        return Found(
            self.fits[at], self.n_a[at], self.n_b[at],
            self.groups[stretches(_starts(self.group_bytes)[at], self.group_bytes[at])], self.group_bytes[at],
            self.links[stretches(_starts(self.n_links)[at], self.n_links[at])], self.n_links[at],
        )

    def then(self, other: Found) -> Found:
        return Found(*[np.concatenate(x) for x in zip(self, other)])


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of each stretch, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - _starts(sizes), sizes)


class Grown:
    """An array that grows at its end."""

    def __init__(self, dtype: str, width: tuple[int, ...] = ()):
        self.room, self.n = np.zeros((1024, *width), dtype=dtype), 0

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.room):
            room = np.zeros((n + n // 4, *self.room.shape[1:]), dtype=self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : n] = more
        self.n = n

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.n]


SIZE, START, FITS, N_A, N_B, GROUP_SIZE, GROUP_START, N_LINKS, LINK_START, USED = range(10)


class ChunkStore:
    """Results of chunks by hash, in arrays of some 100 bytes a chunk. A hash is trusted only after its bytes are compared."""

    def __init__(self, limit: int):
        self.limit, self.clock = limit, 0
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # sorted by hash
        self.chunks, self.bytes, self.groups, self.links = Grown("i4", (10,)), Grown("u1"), Grown("u1"), Grown("<i8")

    def look(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is stored, slot) of chunks given by their place in ``data``."""
        self.clock += 1
        if not len(self.hashes):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slot = self.slots[at]
        rows = self.chunks.rows
        hit = (self.hashes[at] == hashes) & (rows[slot, SIZE] == sizes)
        some = np.flatnonzero(hit)
        same = self.bytes.rows[stretches(rows[slot[some], START].astype(np.int64), sizes[some])] == data[stretches(starts[some], sizes[some])]
        if not same.all():
            hit[some[np.unique(np.repeat(np.arange(len(some)), sizes[some])[~same])]] = False
        rows[slot[hit], USED] = self.clock
        return hit, slot

    def take(self, slots: np.ndarray) -> Found:
        r = self.chunks.rows[slots].astype(np.int64)
        return Found(
            r[:, FITS] > 0, r[:, N_A], r[:, N_B],
            self.groups.rows[stretches(r[:, GROUP_START], r[:, GROUP_SIZE])], r[:, GROUP_SIZE],
            self.links.rows[stretches(r[:, LINK_START], r[:, N_LINKS])], r[:, N_LINKS],
        )

    def add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, found: Found) -> None:
        """Keep more chunks, with distinct hashes; of too many, those used last."""
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            new = np.flatnonzero((sizes <= LONG_CHUNK) & (self.hashes[at] != hashes))
        else:
            new = np.flatnonzero(sizes <= LONG_CHUNK)
        if len(self.hashes) and len(self.hashes) + len(new) > self.limit:
            used = self.chunks.rows[self.slots, USED]
            keep = np.flatnonzero(used > np.median(used))
            slots, kept = self.slots[keep], self.take(self.slots[keep])
            r = self.chunks.rows[slots]
            size, seen = r[:, SIZE].astype(np.int64), r[:, USED]
            text, names = self.bytes.rows[stretches(r[:, START].astype(np.int64), size)], self.hashes[keep]
            self.clear()
            self._append(names, text, size, kept, seen)
        self._append(hashes[new], data[stretches(starts[new], sizes[new])], sizes[new], found.take(new), self.clock)

    def _append(self, hashes: np.ndarray, text: np.ndarray, sizes: np.ndarray, found: Found, used) -> None:
        first = self.chunks.n
        rows = np.zeros((len(hashes), 10), dtype=np.int32)
        columns = {
            SIZE: sizes, START: self.bytes.n + _starts(sizes), FITS: found.fits, N_A: found.n_a, N_B: found.n_b, USED: used,
            GROUP_SIZE: found.group_bytes, GROUP_START: self.groups.n + _starts(found.group_bytes), N_LINKS: found.n_links, LINK_START: self.links.n + _starts(found.n_links),
        }
        for k, v in columns.items():
            rows[:, k] = v
        for to, more in ((self.chunks, rows), (self.bytes, text), (self.groups, found.groups), (self.links, found.links)):
            to.add(more)
        at = np.searchsorted(self.hashes, hashes)  # the new ones are sorted, too
        self.hashes = np.insert(self.hashes, at, hashes)
        self.slots = np.insert(self.slots, at, first + np.arange(len(hashes)))


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def refined(ends: np.ndarray, sure: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Span ends where they are ``sure``, else the sure end before plus the decoded lengths since."""
    total = np.cumsum(lens)
    last = np.maximum.accumulate(np.where(sure, np.arange(len(ends)), -1))
    base = np.where(last >= 0, ends[last] - total[last], 0)
    return np.where(sure, ends, base + total)


class TokenizerPair:
    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letter = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t["content"] for t in json.loads(a_json).get("added_tokens", [])}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = t.encode() if t in added else bytes(letter[c] for c in t)
        n = self.b.get_piece_size()
        self.is_byte = np.array([self.b.is_byte(i) for i in range(n)])
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.is_byte)]
        self.a_len, self.b_len = (np.array([len(x) for x in of], dtype=np.int64) for of in (self.a_bytes, self.b_bytes))
        self.b_size = n
        self.a_names, self.b_names = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(n)]
        self.byte_spans = self.b.encode("é", return_type="proto").pieces[-1].end == 2  # else characters
        self._learn_cuts(b_model)
        self.store = ChunkStore(KEPT_CHUNKS)

    def _learn_cuts(self, b_model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(b_model)
        spec = model.normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        plain = plain and not model.trainer_spec.treat_whitespace_as_suffix and '"ByteLevel"' in self.a.to_str()
        white = np.zeros(256, dtype=bool)
        white[[*range(9, 14), *range(28, 33)]] = True
        ascii_ = np.arange(256) < 128
        self.solid = ascii_ & ~white  # ASCII characters that are no white space
        self.lead2 = (np.arange(256) >= 0xC3) & (np.arange(256) <= 0xDF)  # of characters of two bytes, none of them white space
        self.opens = self.solid | ((np.arange(256) >= 0xC3) & ~np.isin(np.arange(256), [0xE1, 0xE2, 0xE3, 0xEF]))
        self.alnum = np.zeros(256, dtype=bool)
        self.alnum[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
        across = np.zeros((256, 256), dtype=bool)
        for p in self.b_bytes:
            x = np.frombuffer(p, dtype=np.uint8)
            across[x[:-1], x[1:]] = True
        before = self.solid | (np.arange(256) >= 128)
        letters = self.alnum | (np.arange(256) >= 128)
        self.gap, self.mark = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
        if plain:
            for y in b" \n":
                self.gap[y] = not across[before, y].any()
            for y in b".,;:!?":
                self.mark[y] = not across[letters, y].any()

    def cuts(self, d: np.ndarray) -> np.ndarray:
        """Positions before which a chunk may begin; the first and the last two bytes are not judged."""
        if len(d) < 4 or not (self.gap.any() or self.mark.any()):
            return np.zeros(0, dtype=np.int64)
        at, before, more, after = d[2:-1], d[1:-2], d[:-3], d[3:]
        two = (before >= 128) & self.lead2[more]
        gap = self.gap[at] & (self.solid[before] | two) & self.opens[after]
        mark = self.mark[at] & (self.alnum[before] | (two & (more == 0xC3) & (before != 0x97) & (before != 0xB7)))  # the multiplication and division signs
        return np.flatnonzero(gap | mark) + 2

    # -- encoding -------------------------------------------------------------------------------------------------------

    def spans_a(self, text: str, at: np.ndarray | None) -> tuple[list[int], np.ndarray]:
        e = self.a.encode(text, add_special_tokens=False)
        ids = e.ids
        spans = np.fromiter(chain.from_iterable(e.offsets), dtype=np.int64, count=2 * len(ids))
        spans = spans if at is None else at[spans]
        starts, ends = spans[::2], spans[1::2]
        sure = np.ones(len(ids), dtype=bool)
        sure[:-1] = ends[:-1] <= starts[1:]
        return ids, ends if sure.all() else refined(ends, sure, self.a_len[ids])

    def spans_b(self, text: str, at: np.ndarray | None) -> tuple[list[int], np.ndarray]:
        found = list(map(ID_AND_END, self.b.encode(text[1:], return_type="proto").pieces))  # it adds the space itself
        ids = [i for i, _ in found]
        ends = np.fromiter([e for _, e in found], dtype=np.int64, count=len(found)) + 1
        if at is not None and not self.byte_spans:
            ends = at[ends]
        byte = self.is_byte[ids]
        sure = np.ones(len(ids), dtype=bool)
        sure[:-1] = ~(byte[:-1] & byte[1:])
        return ids, ends if sure.all() else refined(ends, sure, self.b_len[ids])

    def entries(self, text: bytes, bounds: np.ndarray) -> list[Entry] | None:
        """The chunks that end at ``bounds`` of ``text``, which begins with a space; None if decoded tokens do not give the text."""
        try:
            chars = text.decode()
        except UnicodeDecodeError:
            return None
        raw = np.frombuffer(text, dtype=np.uint8)
        at = None if len(chars) == len(text) else np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(text))
        a, a_ends = self.spans_a(chars, at)
        b, b_ends = self.spans_b(chars, at)
        if b"".join(map(self.a_bytes.__getitem__, a)) != text or b"".join(map(self.b_bytes.__getitem__, b)) != text:
            return None
        place = np.searchsorted(b_ends, a_ends)  # both end with the text
        ia = np.flatnonzero(b_ends[place] == a_ends)
        ib, cuts = place[ia], a_ends[ia]
        last = np.searchsorted(cuts, bounds)
        if not np.array_equal(cuts[last], bounds):
            return None
        links = (np.array(a, dtype="<i8")[ia] * self.b_size + np.array(b, dtype="<i8")[ib]).tobytes()
        names_a, names_b = list(map(self.a_names.__getitem__, a)), list(map(self.b_names.__getitem__, b))
        groups, i, j = [], 0, 0
        ends_a, ends_b = (ia + 1).tolist(), (ib + 1).tolist()
        for k, m in zip(ends_a, ends_b):
            if k - i == 1 and m - j == 1:
                groups.append(f"{names_a[i]}|{names_b[j]}")
            else:
                groups.append(",".join(names_a[i:k]) + "|" + ",".join(names_b[j:m]))
            i, j = k, m
        out, g0, a0, b0 = [], 0, 0, 0
        for g in (last + 1).tolist():
            a1, b1 = ends_a[g - 1], ends_b[g - 1]
            out.append(Entry(True, a1 - a0, b1 - b0, ";".join(groups[g0:g]).encode(), links[8 * g0 : 8 * g]))
            g0, a0, b0 = g, a1, b1
        return out

    def alone(self, chunk: bytes) -> Entry:
        """A chunk by itself; one that does not begin with a space stands after a word that is dropped again."""
        if chunk[:1] == b" ":
            found = self.entries(chunk, np.array([len(chunk)]))
            return found[0] if found else UNFIT
        found = self.entries(GUARD + chunk, np.array([len(GUARD), len(GUARD) + len(chunk)]))
        return found[1] if found else UNFIT

    def joinable(self, chunks: list[bytes]) -> np.ndarray:
        """Which chunks may be joined: a space or line feed may begin another chunk after them, and begins them."""
        joined = b"".join(chunks)
        d = np.frombuffer(joined, dtype=np.uint8)
        lens = np.array([len(c) for c in chunks], dtype=np.int64)
        ends = np.cumsum(lens)
        two = np.minimum(lens, 2)  # a chunk of one byte is judged by that byte, and not joined
        first, second, last, before = (d[np.maximum(x, 0)] for x in (ends - lens, ends - lens + two - 1, ends - 1, ends - two))
        out = (lens >= 2) & (lens <= LONG_CHUNK) & self.gap[first] & self.opens[second] & (self.solid[last] | ((last >= 128) & self.lead2[before]))
        if UNDERLINE in joined:
            out &= np.array([UNDERLINE not in c for c in chunks])
        return out

    def encode(self, chunks: list[bytes]) -> list[Entry]:
        out: list[Entry] = [UNFIT] * len(chunks)
        if not chunks:
            return out
        some = self.joinable(chunks)
        for i in np.flatnonzero(~some).tolist():
            out[i] = self.alone(chunks[i])
        some = np.flatnonzero(some)
        size = np.cumsum([0, *[len(chunks[i]) for i in some.tolist()]])
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(size, size[lo] + JOINED_BYTES, "right")) - 1)
            batch = [chunks[i] for i in some[lo:hi].tolist()]
            found = self.entries(GUARD + b"".join(batch), len(GUARD) + size[lo : hi + 1] - size[lo])
            for i, e in zip(some[lo:hi].tolist(), found[1:] if found else map(self.alone, batch)):
                out[i] = e
            lo = hi
        return out

    # -- whole texts ----------------------------------------------------------------------------------------------------

    def segments(self, text: bytes) -> Iterator[bytes]:
        """``space + text`` in parts of a bounded size, cut where chunks begin."""
        rest = b" " + text
        lo, size = 0, BLOCK_BYTES
        while len(rest) - lo > size:
            cut = self.cuts(np.frombuffer(rest, dtype=np.uint8, count=size, offset=lo))
            if len(cut):
                yield rest[lo : lo + int(cut[-1])]
                lo, size = lo + int(cut[-1]), BLOCK_BYTES
            else:
                size *= 2
        yield rest[lo:]

    def distinct(self, parts: list[bytes]) -> tuple[Found, np.ndarray, np.ndarray]:
        """(distinct chunks, the number of each chunk of the parts, the part of each chunk)."""
        joined = b"".join(parts)
        d = np.frombuffer(joined + b"  ", dtype=np.uint8)
        first = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        begins = np.zeros(len(joined), dtype=bool)
        begins[first] = begins[self.cuts(d)] = True
        starts = np.flatnonzero(begins)
        part = np.searchsorted(first, starts, "right") - 1
        lens = np.diff(np.append(starts, len(joined)))
        within = stretches(np.zeros(len(lens), dtype=np.int64), lens)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(lens.max()), MULTIPLIER, dtype=np.uint64))
            hashes = mix64(np.add.reduceat((d[: len(joined)].astype(np.uint64) + np.uint64(1)) * powers[within], starts) + lens.astype(np.uint64))
        hashes, one, number = np.unique(hashes, return_index=True, return_inverse=True)
        same = np.array_equal(lens, lens[one][number]) and np.array_equal(d[: len(joined)], d[np.repeat(starts[one][number], lens) + within])
        if not same:  # two chunks of one hash: told apart by their bytes, and not kept
            index: dict[bytes, int] = {}
            number = np.array([index.setdefault(joined[s : s + n], len(index)) for s, n in zip(starts.tolist(), lens.tolist())])
            return Found.of(self.encode(list(index))), number, part
        starts, lens = starts[one], lens[one]
        hit, slot = self.store.look(hashes, d, starts, lens)
        new = np.flatnonzero(~hit)
        made = Found.of(self.encode([joined[s : s + n] for s, n in zip(starts[new].tolist(), lens[new].tolist())]))
        place = np.empty(len(hit), dtype=np.int64)  # in stored ones, then new ones
        place[hit], place[new] = np.arange(int(hit.sum())), int(hit.sum()) + np.arange(len(new))
        found = self.store.take(slot[hit]).then(made).take(place)
        self.store.add(hashes[new], d, starts[new], lens[new], made)
        return found, number, part


@functools.lru_cache(maxsize=2)
def tokenizer_pair(a_json: bytes, b_model: bytes) -> TokenizerPair:
    """One pair, with its cache of chunks, for each Python worker."""
    return TokenizerPair(a_json, b_model)
