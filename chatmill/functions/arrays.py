"""Array expressions. ``let`` binds a computed value once: an expression captured by a lambda would
otherwise be evaluated again for every element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(c: Column) -> Column:
    """``c`` as a column that Catalyst neither pushes down nor copies into later expressions. For costly
    expressions that a filter and a projection both use, and as plain input of Arrow functions."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def pipe(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps in turn, each to the bound result of the one before."""
    for step in steps:
        value = let(value, step)
    return value


def last(c: Column) -> Column:
    """Last element, null when empty."""
    return F.get(c, F.size(c) - 1)


def indices(n: Column) -> Column:
    """0 .. n-1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ngrams(tokens: Column, n: int, sep: str = " ") -> Column:
    """All runs of ``n`` tokens, joined."""
    return let(tokens, lambda t: F.transform(indices(F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i + 1, F.lit(n)), sep)))


def group_starts(sorted_keys: Column) -> Column:
    """0-based positions where a new key starts in a sorted array."""
    return let(sorted_keys, lambda s: F.filter(indices(F.size(s)), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))))


def token_counts(tokens: Column) -> Column:
    """map token -> count by sort and run lengths, n log n in the array."""

    def build(s):
        return let(
            group_starts(s),
            lambda g: F.map_from_arrays(
                F.transform(g, lambda i: F.get(s, i)),
                F.transform(g, lambda i, k: F.coalesce(F.get(g, k + 1), F.size(s)) - i),
            ),
        )

    return let(F.sort_array(tokens), build)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
