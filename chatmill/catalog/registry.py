"""Registered queries with, where SQL can say it, the equivalent DuckDB statement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict = {}
DIGITS = 6


def query(name: str, sql: str | None = None, approx: Sequence[str] = (), cast: dict[str, str] | None = None):
    """Register a query. Columns in ``approx`` are sums of fractions whose last digits depend on the order
    of addition; both sides round them. ``cast`` gives SQL columns the type the query returns."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        if approx:

            def run(spark, sf_dir):
                return fn(spark, sf_dir).withColumns({c: F.round(c, DIGITS) for c in approx})

            QUERIES[name] = run
        else:
            QUERIES[name] = fn
        if sql is not None:
            rounded = ", ".join(f'round("{c}", {DIGITS}) AS "{c}"' for c in approx)
            typed = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in (cast or {}).items())
            changes = ", ".join(x for x in (rounded, typed) if x)
            ORACLES[name] = f"SELECT * REPLACE ({changes}) FROM ({sql})" if changes else sql
        return fn

    return register


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
