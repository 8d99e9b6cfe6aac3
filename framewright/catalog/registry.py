"""Registry of named queries: a Spark callable and, where possible, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def r6(expr: str) -> str:
    """Round in SQL to six digits, as ``bindings.r6`` does, without a negative zero."""
    return f"(round(({expr}) + 1e-9, 6) + 0.0)"


def r4(expr: str) -> str:
    """Round in SQL to four digits without a negative zero."""
    return f"(round(({expr}) + 1e-7, 4) + 0.0)"


def sql_uniform(key: str) -> str:
    """``rng.uniform`` in SQL; ``key`` is the text expression of the joined parts."""
    return f"(('0x' || substr(md5({key}), 1, 8))::UBIGINT::DOUBLE / 4294967296)"


def sql_normal(key: str) -> str:
    """``rng.normal`` in SQL."""
    first, second = sql_uniform(f"{key} || ':a'"), sql_uniform(f"{key} || ':b'")
    return f"(sqrt(-2.0 * ln(greatest({first}, 1e-12))) * cos(2.0 * pi() * {second}))"
