"""Dataset preparation: ordered and seeded splits, shuffles, subsamples, pairings and quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import rng
from framewright.operators.scans import BLOCK, bounded_broadcast, number_rows, running_sum


def _share(n: Column, frac: float) -> Column:
    return F.floor(n * F.lit(frac))


def split_ordered(df: DataFrame, order: Sequence[str], frac: float = 0.9, limit: int | None = None,
                  limit_valid: int | None = None) -> DataFrame:
    """Add ``split``: the first part of the order is ``train``, the rest ``valid``; limits cut each side."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = number_rows(df, list(order), out="_no").withColumn("_cut", _share(total, frac))
    rows = rows.withColumn("split", F.when(F.col("_no") < F.col("_cut"), "train").otherwise("valid"))
    pos = F.when(F.col("split") == "train", F.col("_no")).otherwise(F.col("_no") - F.col("_cut"))
    keep = F.lit(True)
    if limit is not None:
        keep = keep & ((F.col("split") != "train") | (pos < limit))
    if limit_valid is not None:
        keep = keep & ((F.col("split") != "valid") | (pos < limit_valid))
    return rows.filter(keep).drop("_no", "_cut")


def split_random(df: DataFrame, key: str, frac: float, seed: int, cap: int | None = None) -> DataFrame:
    """Add ``split`` by seeded hash order: exactly floor(n * frac) rows train, at most ``cap`` rows valid."""
    hashed = df.withColumn("_hash", rng.hash_key(seed, F.col(key)))
    return split_ordered(hashed, ["_hash", key], frac, None, cap).drop("_hash")


def combine(parts: Sequence[DataFrame], key: str, seed: int | None = None) -> DataFrame:
    """Concatenate datasets: dataset, row (place in its dataset), index (global), place (after the shuffle).

    Each part needs ``key``, unique in it, as its order.
    """
    union = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("dataset", F.lit(i))
        union = tagged if union is None else union.unionByName(tagged)
    rows = number_rows(union, [key], ["dataset"], out="row")
    # The datasets follow each other, so the global number is the local one behind the earlier datasets.
    sizes = union.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(W.orderBy("dataset").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("dataset", earlier.alias("_start"))  # one row per dataset
    rows = rows.join(F.broadcast(starts), "dataset").withColumn("index", F.col("_start") + F.col("row")).drop("_start")
    if seed is None:
        return rows.withColumn("place", F.col("index"))
    rows = rows.withColumn("_hash", rng.hash_key(seed, F.col("index")))
    return number_rows(rows, ["_hash", "index"], out="place").drop("_hash")


def subsample(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Every n-th row of the order, beginning with the first."""
    return number_rows(df, list(order), out="_no").filter(F.col("_no") % n == 0).drop("_no")


def holdout(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Add ``split``: every n-th row is ``valid`` and leaves ``train``."""
    rows = number_rows(df, list(order), out="_no")
    return rows.withColumn("split", F.when(F.col("_no") % n == 0, "valid").otherwise("train")).drop("_no")


def pair_modalities(parts: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """Inner join of the modalities by key, and a report (key, missing) of the unpaired ones."""
    paired, present = None, None
    for name, part in parts.items():
        paired = part if paired is None else paired.join(part, key)
        tags = part.select(key, F.lit(name).alias("_has"))
        present = tags if present is None else present.unionByName(tags)
    have = present.groupBy(key).agg(F.collect_set("_has").alias("_has"))
    missing = F.array_except(F.array(*[F.lit(n) for n in parts]), F.col("_has"))
    report = have.withColumn("missing", missing).filter(F.size("missing") > 0).select(key, "missing")
    return paired, report


def limit_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of the order."""
    return df.orderBy(*order).limit(n)


def truncate_pair(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cut two arrays to the shorter length."""
    size = F.least(F.size(a), F.size(b))
    return df.select(*[c for c in df.columns if c not in (a, b)],
                     F.slice(a, F.lit(1), size).alias(a), F.slice(b, F.lit(1), size).alias(b))


def round_robin(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Add ``bucket``: the rows of the order dealt out to ``k`` buckets in turn."""
    return number_rows(df, list(order), out="_no").withColumn("bucket", F.col("_no") % k).drop("_no")


def quota_filter(df: DataFrame, speaker: str, order: str, seconds: str, score: str, min_score: float,
                 cap_seconds: float, block: int = BLOCK) -> DataFrame:
    """Rows above the score, per speaker in order until their total passes the cap.

    ``order`` is unique within a speaker. Rows are ranked first, so that blocks are
    full however sparse the order's values are and no window holds a whole speaker.
    """
    ranked = number_rows(df.filter(F.col(score) > min_score), [order], [speaker], out="_pos")
    rows = running_sum(ranked, speaker, F.col(seconds), "_total", pos="_pos", block=block)
    return rows.filter(F.col("_total") <= cap_seconds).drop("_total", "_pos")


def speaker_band(df: DataFrame, speaker: str, seconds: str, low: float, high: float) -> DataFrame:
    """All rows of the speakers whose total lies within [low, high]."""
    totals = df.groupBy(speaker).agg(F.sum(seconds).alias("_total"))
    kept = totals.filter(F.col("_total").between(low, high)).select(speaker)
    return df.join(bounded_broadcast(kept, F.octet_length(F.col(speaker).cast("string")) + 64, 64 << 20), speaker, "left_semi")
