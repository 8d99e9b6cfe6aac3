"""Registered queries, one module per section of the operator inventory."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("series", "mixing", "pool", "segments", "editing", "text", "sources", "datasets", "evaluate", "workflows")


def load():
    """Import every section and return (queries, oracle SQL)."""
    for section in SECTIONS:
        import_module(f"framewright.catalog.{section}")
    registry = import_module("framewright.catalog.registry")
    return registry.QUERIES, registry.ORACLE
