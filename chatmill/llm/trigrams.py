"""Boolean trigram queries of regular expressions, and postings that answer them inside a block of texts.

A query is True (any text may match), a trigram of ASCII-lower-cased UTF-8 bytes, or ("and" | "or", parts). A text that
matches the expression satisfies its query; most texts that do not match fail it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser  # the standard library's own parse tree

import numpy as np

MAX_STRINGS = 64  # a set of alternatives beyond this is no longer followed
MAX_CLASS = 16  # characters of a class that are told apart
SLICE = 1 << 20  # positions of a block looked at together
FILTER_BITS = 16
Query = bool | bytes | tuple


def both(*queries: Query) -> Query:
    return _join("and", True, queries)


def either(*queries: Query) -> Query:
    if True in queries:
        return True
    return _join("or", False, queries)


def _join(kind: str, neutral: bool, queries: tuple[Query, ...]) -> Query:
    parts: set = set()
    for q in queries:
        if isinstance(q, tuple) and q[0] == kind:
            parts |= q[1]
        elif q is not neutral:
            parts.add(q)
    if not parts:
        return neutral
    return next(iter(parts)) if len(parts) == 1 else (kind, frozenset(parts))


def of_strings(strings: frozenset[bytes]) -> Query:
    """A text that holds one of the strings holds all trigrams of that string."""
    return either(*[both(*[s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass(frozen=True)
class Known:
    """What is known of the texts that an expression matches: all of them, or how they begin and end and a query."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    query: Query


NOTHING = frozenset([b""])
ANYTHING = Known(None, NOTHING, NOTHING, True)
EMPTY = Known(NOTHING, NOTHING, NOTHING, True)


def _ends(strings: frozenset[bytes], cut) -> frozenset[bytes]:
    """The strings cut to fewer bytes until there are few of them."""
    for n in (3, 2, 1):
        short = frozenset(cut(s, n) for s in strings)
        if len(short) <= MAX_STRINGS:
            return short
    return NOTHING


def _first(strings: frozenset[bytes]) -> frozenset[bytes]:
    return _ends(strings, lambda s, n: s[:n])


def _last(strings: frozenset[bytes]) -> frozenset[bytes]:
    return _ends(strings, lambda s, n: s[-n:])


def _open(x: Known) -> Known:
    """The same knowledge without the complete list."""
    return x if x.exact is None else Known(None, _first(x.exact), _last(x.exact), of_strings(x.exact))


def _exactly(strings: frozenset[bytes]) -> Known:
    x = Known(strings, NOTHING, NOTHING, True)
    return x if len(strings) <= MAX_STRINGS else _open(x)


def _then(x: Known, y: Known) -> Known:
    """One text after the other."""
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_STRINGS:
        return _exactly(frozenset(a + b for a in x.exact for b in y.exact))
    a, b = _open(x), _open(y)
    across = frozenset(s + p for s in a.suffix for p in b.prefix)
    prefix = _first(frozenset(s + p for s in x.exact for p in b.prefix)) if x.exact is not None and len(x.exact) * len(b.prefix) <= MAX_STRINGS else a.prefix
    suffix = _last(frozenset(s + e for s in a.suffix for e in y.exact)) if y.exact is not None and len(y.exact) * len(a.suffix) <= MAX_STRINGS else b.suffix
    return Known(None, prefix, suffix, both(a.query, b.query, of_strings(across)))


def _or(x: Known, y: Known) -> Known:
    if x.exact is not None and y.exact is not None:
        return _exactly(x.exact | y.exact)
    a, b = _open(x), _open(y)
    return Known(None, _first(a.prefix | b.prefix), _last(a.suffix | b.suffix), either(a.query, b.query))


def _fold(code: int) -> bytes:
    return chr(code + 32 if 65 <= code <= 90 else code).encode("utf-8", "surrogatepass")


def _class(items: list) -> Known:
    chars: set[bytes] = set()
    for op, value in items:
        name = str(op)
        if name == "LITERAL":
            chars.add(_fold(value))
        elif name == "RANGE" and value[1] - value[0] < 128:
            chars |= {_fold(c) for c in range(value[0], value[1] + 1)}
        else:  # negated, a category or a wide range
            return ANYTHING
    return _exactly(frozenset(chars)) if len(chars) <= MAX_CLASS else ANYTHING


def _node(op, value) -> Known:
    name = str(op)
    if name == "LITERAL":
        return _exactly(frozenset([_fold(value)]))
    if name == "IN":
        return _class(value)
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        return reduce(_or, [_sequence(x) for x in value[1]])
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, body = value
        x = _sequence(body)
        if not least:
            return _or(EMPTY, x) if most == 1 else ANYTHING
        copies = reduce(_then, [x] * min(least, 3))
        if least == most <= 3:
            return copies
        end = _open(reduce(_then, [x] * min(least, 3)))
        return Known(None, end.prefix, end.suffix, end.query)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):  # no text of their own
        return EMPTY
    return ANYTHING


def _sequence(nodes) -> Known:
    return reduce(_then, [_node(op, value) for op, value in nodes], EMPTY)


def query_of(pattern: str, flags: int = 0) -> Query:
    """The trigram query of an expression that is matched by ``re`` with re.ASCII."""
    return _open(_sequence(_parser.parse(pattern, flags | re.ASCII))).query


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*[trigrams_of(q) for q in query[1]]) if isinstance(query, tuple) else set()


class Vocabulary:
    """The trigrams that a set of queries asks for."""

    def __init__(self, queries: list[Query]):
        asked = sorted(set().union(*[trigrams_of(q) for q in queries]))
        self.names = asked
        self.codes = np.array([int.from_bytes(t, "big") for t in asked], dtype=np.uint32)
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[self._hash(self.codes)] = True

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(32 - FILTER_BITS)

    def postings(self, folded: np.ndarray, offsets: np.ndarray) -> dict[bytes, np.ndarray]:
        """The sorted rows of each trigram; row r has the bytes offsets[r] up to offsets[r + 1]. A trigram that reaches into
        the next row is posted too, which only adds a candidate."""
        n, found = len(offsets) - 1, []
        for lo in range(0, len(folded) - 2 if len(self.codes) else 0, SLICE):
            d = folded[lo : lo + SLICE + 2].astype(np.uint32)
            codes = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
            near = np.flatnonzero(self.maybe[self._hash(codes)])
            place = np.minimum(np.searchsorted(self.codes, codes[near]), len(self.codes) - 1)
            hit = self.codes[place] == codes[near]
            rows = np.searchsorted(offsets, near[hit] + lo, "right") - 1
            found.append(np.unique(place[hit] * n + rows))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        cuts = np.searchsorted(keys, np.arange(len(self.names) + 1) * n)
        return {t: keys[cuts[i] : cuts[i + 1]] - i * n for i, t in enumerate(self.names)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """The rows that satisfy the query: postings are intersected, the shortest first, or united."""
    if query is True:
        return np.arange(n)
    if query is False:
        return np.zeros(0, dtype=np.int64)
    if isinstance(query, bytes):
        return postings[query]
    parts = sorted((candidates(q, postings, n) for q in query[1]), key=len)
    if query[0] == "or":
        return reduce(np.union1d, parts)
    return reduce(lambda a, b: np.intersect1d(a, b, assume_unique=True) if len(a) else a, parts)
