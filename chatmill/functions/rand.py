"""Portable randomness: an order derived from md5(seed|id), the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *ids) -> Column:
    """Hex digest that serves as a random sort key; ties are impossible for distinct ids in practice."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(i) if isinstance(i, str) else i for i in ids]))


def hash_int(seed, *ids) -> Column:
    """First 32 bits of the digest as a non-negative long."""
    return F.conv(F.substring(hash_key(seed, *ids), 1, 8), 16, 10).cast("long")


def hash_unit(seed, *ids) -> Column:
    """Uniform value in [0, 1)."""
    return hash_int(seed, *ids) / F.lit(4294967296.0)


def hash_pick(n: Column, seed, *ids) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(hash_int(seed, *ids), n.cast("long"))
