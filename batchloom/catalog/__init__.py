"""Registered queries over the given tables, each with SQL to check it against."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ["reporting", "inputs", "launching", "events", "scheduling", "streams"]


def load() -> None:
    """Import every group, which registers its queries."""
    for name in _GROUPS:
        import_module(f"batchloom.catalog.{name}")
