"""Ordered operators that never put one whole key into one task.

A recording, speaker or group may hold a large share of all rows, so
``Window.partitionBy(key)`` is not safe. Rows are cut into blocks of the order
column (``block = pos div size``); windows run per (key, block), and what has to
cross a block boundary travels either as one carry row per block or as copied
halo rows. ``pos`` only has to be a non-negative integer that grows with the
order. For orders without such a column ``number_rows`` makes one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.session import materialize, widen_shuffles

BLOCK = 65536
TASK_ROWS = 1 << 20  # rows that one task sorts, about
_BLK, _KEY = "_blk", "_key"


def _cols(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _block(pos: str, size: int) -> Column:
    return F.expr(f"`{pos}` div {int(size)}")


def _keyed(df: DataFrame, keys: list[str], pos: str, block: int) -> DataFrame:
    """Add the block, and the keys as one struct: it is never null itself, so null keys join like others."""
    return df.withColumn(_BLK, _block(pos, block)).withColumn(_KEY, F.struct(*[F.col(k) for k in keys]))


def _every_block(per_key: DataFrame) -> DataFrame:
    """One row per key and block, from one row per key with its last block."""
    return per_key.withColumn(_BLK, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last_blk").cast("bigint")))).drop("_last_blk")


def with_totals(
    df: DataFrame, keys, aggs: Sequence[Column], pos: str = "frame", block: int = BLOCK
) -> DataFrame:
    """Add per-key aggregates to every row.

    The aggregate combines map-side; its row is then repeated per block of the
    key, so the join back is on (key, block) and a hot key spreads out.
    """
    rows = _keyed(df, _cols(keys), pos, block)
    totals = _every_block(rows.groupBy(_KEY).agg(*aggs, F.max(_BLK).alias("_last_blk")))
    return rows.join(totals, [_KEY, _BLK]).drop(_KEY, _BLK)


def attach(df: DataFrame, table: DataFrame, keys, pos: str = "frame", block: int = BLOCK) -> DataFrame:
    """Join a table with one row per key to the rows, spread over blocks like ``with_totals``."""
    keys = _cols(keys)
    rows = _keyed(df, keys, pos, block)
    spans = rows.groupBy(_KEY).agg(F.max(_BLK).alias("_last_blk"))
    facts = table.withColumn(_KEY, F.struct(*[F.col(k) for k in keys])).drop(*keys)
    return rows.join(_every_block(facts.join(spans, _KEY)), [_KEY, _BLK]).drop(_KEY, _BLK)


def scan(
    df: DataFrame, keys, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None, totals: dict[str, tuple[str, Column]] | None = None, pos: str = "frame",
    block: int = BLOCK, inclusive: bool = True,
) -> DataFrame:
    """Several ordered results of one table in one pass: one summary per block, one join back.

    ``sums``, ``lasts`` (latest non-null value) and ``maxima`` run in ``pos`` order,
    over the row itself too if ``inclusive``; ``totals`` gives ``{out: (function,
    value)}`` over the whole key with sum, min or max. The table is read twice,
    however many results are asked for. ``pos`` must not be null.
    """
    sums, lasts, maxima, totals = sums or {}, lasts or {}, maxima or {}, totals or {}
    rows = _keyed(df, _cols(keys), pos, block)
    values = {**sums, **lasts, **maxima, **{out: value for out, (_, value) in totals.items()}}
    rows = rows.withColumns({f"_v_{out}": value for out, value in values.items()})
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    summary = rows.groupBy(_KEY, _BLK).agg(
        *[F.sum(f"_v_{o}").alias(f"_s_{o}") for o in sums],
        *[F.max_by(f"_v_{o}", F.when(F.col(f"_v_{o}").isNotNull(), F.col(pos))).alias(f"_s_{o}") for o in lasts],
        *[F.max(f"_v_{o}").alias(f"_s_{o}") for o in maxima],
        *[combine[f](f"_v_{o}").alias(f"_s_{o}") for o, (f, _) in totals.items()])
    before = W.partitionBy(_KEY).orderBy(_BLK).rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        _KEY, _BLK,
        *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in sums],
        *[F.last(f"_s_{o}", ignorenulls=True).over(before).alias(f"_c_{o}") for o in lasts],
        *[F.max(f"_s_{o}").over(before).alias(f"_c_{o}") for o in maxima],
        *[combine[f](f"_s_{o}").over(W.partitionBy(_KEY)).alias(o) for o, (f, _) in totals.items()])
    upto = W.partitionBy(_KEY, _BLK).orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    local = upto if inclusive else W.partitionBy(_KEY, _BLK).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(carry, [_KEY, _BLK])
    out = {o: F.col(f"_c_{o}") + F.coalesce(F.sum(f"_v_{o}").over(upto), F.lit(0)) for o in sums}
    if not inclusive:
        out = {o: total - F.coalesce(F.col(f"_v_{o}"), F.lit(0)) for o, total in out.items()}
    out |= {o: F.coalesce(F.last(f"_v_{o}", ignorenulls=True).over(local), F.col(f"_c_{o}")) for o in lasts}
    out |= {o: F.greatest(F.max(f"_v_{o}").over(local), F.col(f"_c_{o}")) for o in maxima}
    if out:
        rows = rows.withColumns(out)
    return rows.drop(_KEY, _BLK, *[f"_v_{o}" for o in values], *[f"_c_{o}" for o in [*sums, *lasts, *maxima]])


def running_sum(
    df: DataFrame, keys, value: Column, out: str, pos: str = "frame", block: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` in ``pos`` order within each key."""
    return scan(df, keys, sums={out: value}, pos=pos, block=block, inclusive=inclusive)


def running_last(
    df: DataFrame, keys, value: Column, out: str, pos: str = "frame", block: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Latest non-null ``value`` at or before each row (strictly before if not inclusive)."""
    return scan(df, keys, lasts={out: value}, pos=pos, block=block, inclusive=inclusive)


def running_max(
    df: DataFrame, keys, values: dict[str, Column], pos: str, block: int = BLOCK
) -> DataFrame:
    """Running maxima {out: value} in ``pos`` order within each key."""
    return scan(df, keys, maxima=values, pos=pos, block=block)


def with_neighbours(
    df: DataFrame, keys, exprs: dict[str, Callable[[W], Column]], before: int = 0, after: int = 0,
    pos: str = "frame", block: int = BLOCK,
) -> DataFrame:
    """Window expressions that look at most ``before`` / ``after`` positions away.

    ``pos`` must be dense per key when the expressions use ROWS frames, lag or
    lead. Rows near a block edge are copied into the neighbour block, used by
    the window there and dropped again; each expression gets the window to use.
    """
    keys = _cols(keys)
    first = F.expr(f"greatest(`{pos}` - {int(after)}, 0) div {int(block)}")
    last = F.expr(f"(`{pos}` + {int(before)}) div {int(block)}")
    rows = (
        df.withColumn(_BLK, F.explode(F.sequence(first, last)))
        .withColumn("_home", F.col(_BLK) == _block(pos, block))
    )
    w = W.partitionBy(*keys, _BLK).orderBy(pos)
    for name, make in exprs.items():
        rows = rows.withColumn(name, make(w))
    return rows.filter("_home").drop(_BLK, "_home")


def with_lag_lead(
    df: DataFrame, keys, lag: dict[str, str] | None = None, lead: dict[str, str] | None = None,
    pos: str = "frame", block: int = BLOCK,
) -> DataFrame:
    """Add the previous (``lag``) or next (``lead``) value of columns, given as {out: column}."""
    exprs: dict[str, Callable] = {}
    for out, col in (lag or {}).items():
        exprs[out] = lambda w, c=col: F.lag(c).over(w)
    for out, col in (lead or {}).items():
        exprs[out] = lambda w, c=col: F.lead(c).over(w)
    return with_neighbours(df, keys, exprs, 1 if lag else 0, 1 if lead else 0, pos, block)


def number_rows(df: DataFrame, order, keys=(), out: str = "row_no", parts: int | None = None,
                task_rows: int = TASK_ROWS) -> DataFrame:
    """Dense numbers from 0 in the given (unique, ascending) order, globally or per key.

    Spark ranges the rows by key and order (split points from samples of all partitions)
    and sorts each range; a row's place in its range is its number there, plus the sizes of the
    ranges before. Per key, the key's least number is taken off. The rows are
    shuffled once and written once, which pins their places; what else is joined has a
    row per range or per key. ``df`` is counted and read twice. Ranges and later shuffles are as many as
    keep about ``task_rows`` rows in a task, however large the table.
    """
    keys = _cols(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in ([order] if isinstance(order, (str, Column)) else order)]
    parts = parts or widen_shuffles(df.sparkSession, -(-df.count() // task_rows))
    by = [*[F.col(k) for k in keys], *order]
    placed = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranges")
    # The id holds the range above the place (33 bits).
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = ranges.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))  # one row per range
    numbered = placed.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_range").withColumn(
        "_no", F.col("_off") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    names = [c for c in df.columns if c != out]
    if not keys:
        return numbered.select(*names, F.col("_no").alias(out))
    # One struct of the keys is never null itself, so null keys join.
    numbered = numbered.withColumn(_KEY, F.struct(*[F.col(k) for k in keys]))
    starts = materialize(numbered.groupBy(_KEY).agg(F.min("_no").alias("_start")), "key-starts")
    return numbered.join(starts, _KEY).select(*names, (F.col("_no") - F.col("_start")).alias(out))


def bounded_broadcast(df: DataFrame, size: Column, limit_bytes: int) -> DataFrame:
    """Broadcast hint only after measuring the table (``size`` = bytes of one row)."""
    measured = df.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(df) if measured <= limit_bytes else df
