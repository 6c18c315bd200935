"""Queries of the subpackage and, where SQL can say it, their DuckDB statements."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ["queries"]


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"chatmill.llm.{m}")
    return dict(QUERIES), dict(ORACLES)
