"""Registered queries over the given tables."""

from __future__ import annotations

import importlib
from types import SimpleNamespace

MODULES = ("uplift", "series", "matching", "frames", "sinks", "models")


def load() -> SimpleNamespace:
    """Import every query module and return the registry."""
    for name in MODULES:
        importlib.import_module(f"catalog.{name}")
    from catalog.registry import ORACLES, QUERIES

    return SimpleNamespace(queries=QUERIES, oracles=ORACLES)
