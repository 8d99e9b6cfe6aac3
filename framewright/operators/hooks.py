"""Places where user functions attach: batch models, ordered folds and guarded row functions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_model(df: DataFrame, loader: Callable[[], object], fn: Callable[[object, pd.DataFrame], pd.DataFrame],
              schema: str, name: str = "model") -> DataFrame:
    """``fn(model, batch)`` over Arrow batches; ``loader`` runs once per worker process and ``name``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = sys.__dict__.setdefault("_framewright_models", {})
        for batch in batches:
            if name not in cache:
                cache[name] = loader()
            yield fn(cache[name], batch)

    return df.mapInPandas(run, schema)


def fold_frames(df: DataFrame, step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame | None]],
                finish: Callable[[object], pd.DataFrame | None], schema: str, keys="utt_id",
                pos: str = "frame") -> DataFrame:
    """Sequential fold of each recording: ``step(state, rows) -> (state, output)``, then ``finish(state)``.

    ``state`` is None at the start of a key. Rows arrive sorted and in Arrow
    batches, so a recording is streamed through its task and never held whole;
    a key may reach ``step`` in several pieces.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            for key, rows in batch.groupby(keys, sort=False):
                if current is not None and key != current:
                    out = finish(state)
                    if out is not None and len(out):
                        yield out
                    state = None
                current = key
                state, out = step(state, rows)
                if out is not None and len(out):
                    yield out
        if current is not None:
            out = finish(state)
            if out is not None and len(out):
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys, pos).mapInPandas(run, schema)


def map_groups(df: DataFrame, keys, order, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` on each small group, sorted by ``order``.

    Like ``applyInPandas``, but many groups share one Arrow batch, which matters
    when groups have few rows. Groups must be bounded by the caller.
    """
    keys, order = list(keys), list(order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []  # of the group that the last batch left open; joined once
        for batch in batches:
            if not len(batch):
                continue
            changed = False
            for key in keys:
                column = batch[key].to_numpy()
                changed = changed | (column[1:] != column[:-1])
            cuts = [0, *(int(i) + 1 for i in changed.nonzero()[0]), len(batch)]
            groups = [batch.iloc[a:b] for a, b in zip(cuts, cuts[1:])]
            done = []
            if rest and any(rest[-1][key].iloc[-1] != batch[key].iloc[0] for key in keys):
                done.append(fn(pd.concat(rest, ignore_index=True)))
                rest = []
            if len(groups) > 1:
                done.append(fn(pd.concat([*rest, groups[0]], ignore_index=True)))
                done += [fn(group) for group in groups[1:-1]]
                rest = []
            rest.append(groups[-1])
            if done:
                yield pd.concat(done, ignore_index=True)
        if rest:
            yield fn(pd.concat(rest, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def try_rows(df: DataFrame, fn: Callable, kind: str, *inputs: Column, out: str = "value") -> DataFrame:
    """Add ``out`` and ``error``: ``fn(*values)`` per row; a failing row becomes an error text, the rest goes on."""

    @F.pandas_udf(f"struct<value: {kind}, error: string>")
    def guarded(*cols: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for args in zip(*cols):
            try:
                values.append(fn(*args))
                errors.append(None)
            except Exception as e:  # noqa: BLE001
                values.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": values, "error": errors})

    return df.withColumn("_t", guarded(*inputs)).withColumn(out, F.col("_t.value")).withColumn(
        "error", F.col("_t.error")).drop("_t")
