"""Registered queries over the driver tables, grouped by the operators they exercise."""

from __future__ import annotations

import importlib

from chatmill.catalog import registry

MODULES = ["chats", "documents", "mixes", "overlap", "preferences", "scored", "verifiers", "packing", "streams", "rules", "shapes", "sketched"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"chatmill.catalog.{m}")


def queries() -> dict:
    _load()
    return dict(registry.QUERIES)


def oracles() -> dict:
    _load()
    return dict(registry.ORACLES)
