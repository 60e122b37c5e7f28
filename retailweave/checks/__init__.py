"""Registered queries: every operator on the shared tables, with reference SQL where SQL can say it."""

from __future__ import annotations

import importlib

MODULES = ("reporting", "imports", "competition", "matching", "streams")


def load_registry():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    registry = importlib.import_module(f"{__name__}.registry")
    return registry.QUERIES, registry.SQL
