"""Stateless randomness: every draw is a hash of (seed, key).

The result depends on neither partitioning nor row order, and any SQL engine
with md5 can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(part)).cast("string")


def hash_key(*parts) -> Column:
    """md5 of the parts joined with ``:``; sort by it for a seeded order."""
    return F.md5(F.concat_ws(":", *[_text(p) for p in parts]))


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def normal(*parts) -> Column:
    """Standard normal by Box-Muller on two uniforms of the same key."""
    radius = F.sqrt(-2.0 * F.log(F.greatest(uniform(*parts, "a"), F.lit(1e-12))))
    return radius * F.cos(2.0 * F.pi() * uniform(*parts, "b"))
