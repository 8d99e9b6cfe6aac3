"""Column expressions on vectors kept as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(fn, **values: Column) -> Column:
    """Evaluate the values once and hand them to ``fn`` as fields of one struct.

    A column used inside a lambda is evaluated again for every element when the
    optimizer merges projections; a lambda variable is not.
    """
    return F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), fn)[0]


def vsum(v) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def add(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def cosine(a, b) -> Column:
    """Cosine similarity; NaN when a vector is all zero."""
    return let(
        lambda s: F.coalesce(F.try_divide(
            dot(s["a"], s["b"]), F.sqrt(dot(s["a"], s["a"])) * F.sqrt(dot(s["b"], s["b"]))), F.lit(float("nan"))),
        a=a, b=b)


def unit(v: Column, centre: bool) -> Column:
    """Scale to length one, after removing the mean if ``centre``; a zero vector gives NaN entries."""
    if centre:
        v = let(lambda s: F.transform(s["v"], lambda x: x - s["m"]), v=v, m=vsum(v) / F.size(v))
    return let(
        lambda s: let(
            lambda t: F.transform(t["v"], lambda x: F.coalesce(F.try_divide(x, t["n"]), F.lit(float("nan")))),
            v=s["v"], n=F.sqrt(dot(s["v"], s["v"]))),
        v=v)
