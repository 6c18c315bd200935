"""Phrase search by a multi-pattern automaton that runs inside the row.

All phrases of a slice are one automaton over token numbers: a trie whose states fall back to the longest suffix that is
also in it, so a message is read once whatever the number of phrases, and a phrase of one very common token costs one
row for each message and item, never one for each occurrence. Slices have a checked number of tokens; a phrase set over
the limit is read in several passes, none of which shuffles a message.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chatmill.functions import text as X

SLICE_TOKENS = 250_000  # of one automaton: some 50 MB in a task


class Automaton:
    """Finds which of some sequences of small numbers occur in a longer sequence."""

    def __init__(self, patterns: list[tuple[int, ...]], symbols: int):
        self.symbols = symbols
        self.step: dict[int, int] = {}  # state * symbols + symbol -> state
        self.ends: dict[int, int] = {}  # state -> the pattern that ends there
        states = 1
        for number, pattern in enumerate(patterns):
            at = 0
            for x in pattern:
                key = at * symbols + x
                if key not in self.step:
                    self.step[key] = states
                    states += 1
                at = self.step[key]
            self.ends[at] = number
        self.back = [0] * states  # the state of the longest proper suffix
        self.report = [0] * states  # the nearest state along the suffixes, itself included, where a pattern ends
        children: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.step.items():
            children.setdefault(key // symbols, []).append((key % symbols, to))
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for x, to in children.get(at, ()):
                if at:
                    fall = self.back[at]
                    while fall and fall * symbols + x not in self.step:
                        fall = self.back[fall]
                    self.back[to] = self.step.get(fall * symbols + x, 0)
                self.report[to] = to if to in self.ends else self.report[self.back[to]]
                queue.append(to)

    def find(self, places: list[int], symbols: list[int]) -> set[int]:
        """The patterns in a sequence of which only the known symbols, with their places, are given."""
        step, back, report, n = self.step, self.back, self.report, self.symbols
        at, last, told = 0, -2, set()
        for place, x in zip(places, symbols):
            if place != last + 1:
                at = 0
            last = place
            to = step.get(at * n + x)
            while to is None and at:
                at = back[at]
                to = step.get(at * n + x)
            at = to or 0
            told.add(report[at])
        out = set()
        for state in told:
            while state and self.ends[state] not in out:  # from there on all shorter ones are known
                out.add(self.ends[state])
                state = report[back[state]]
        return out


class PhraseSet:
    """The fields of some items: which items have all their fields in a message."""

    def __init__(self, rows: Iterable[tuple[object, int, list[str]]], n_fields: int):
        number: dict[str, int] = {}
        pattern: dict[tuple[int, ...], int] = {}
        self.items: list = []
        item_number: dict = {}
        self.of_pattern: list[list[tuple[int, int]]] = []
        for item, field, tokens in rows:
            i = item_number.setdefault(item, len(item_number))
            if i == len(self.items):
                self.items.append(item)
            key = tuple(number.setdefault(t, len(number)) for t in tokens)
            p = pattern.setdefault(key, len(pattern))
            if p == len(self.of_pattern):
                self.of_pattern.append([])
            self.of_pattern[p].append((i, field))
        self.words, self.n_fields = pa.array(list(number), pa.string()), n_fields
        self.automaton = Automaton(list(pattern), max(len(number), 1))

    def matches(self, tokens: pa.ListArray) -> tuple[list[int], list[int]]:
        """(rows, item numbers) of a column of token lists."""
        codes = pc.index_in(tokens.flatten(), value_set=self.words)
        known = np.flatnonzero(codes.is_valid().to_numpy(zero_copy_only=False))
        codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(known, tokens.offsets.to_numpy() - tokens.offsets[0].as_py())
        rows, items = [], []
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            at = known[cuts[r] : cuts[r + 1]]
            fields: dict[int, set[int]] = {}
            for p in self.automaton.find(at.tolist(), codes[at].tolist()):
                for i, f in self.of_pattern[p]:
                    fields.setdefault(i, set()).add(f)
            found = [i for i, f in fields.items() if len(f) == self.n_fields]
            rows += [r] * len(found)
            items += found
        return rows, items


def scan(docs: DataFrame, phrases: DataFrame, ids: str, n_fields: int, slices: int = 1) -> DataFrame:
    """(ids, msg, item): messages that contain all fields of an item. ``phrases``: (item, field, tokens), no empty tokens."""
    spark = docs.sparkSession
    schema = T.StructType([docs.schema[ids], docs.schema["msg"], T.StructField("item", phrases.schema["item"].dataType)])
    numbers = phrases.select("field").distinct()  # as many as there are fields
    order = {r["field"]: k for k, r in enumerate(numbers.orderBy("field").collect())}
    messages = docs.select(ids, "msg", X.phrase_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    out = None
    for k in range(slices):
        part = phrases.filter(F.pmod(F.xxhash64("item"), F.lit(slices)) == k)
        rows = [(r["item"], order[r["field"]], r["tokens"]) for r in part.select("item", "field", "tokens").collect()]  # a slice
        shared = spark.sparkContext.broadcast(PhraseSet(rows, n_fields))
        found = messages.mapInArrow(_matcher(shared, schema.fieldNames(), phrases.schema["item"].dataType), schema)
        out = found if out is None else out.unionByName(found)
    return out.distinct()  # of hits only


def _matcher(shared, names: list[str], kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows, items = shared.value.matches(b.column(2))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([shared.value.items[i] for i in items], arrow)], names=names)

    return run
