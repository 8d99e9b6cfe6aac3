"""Evaluation: word error rate, similarity, timing, cost, thresholds and comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions.text import normalize_words
from framewright.functions.vectors import cosine
from framewright.operators.scans import bounded_broadcast, number_rows
from framewright.session import materialize

SMALL = 64 << 20


def _edits(ref, hyp) -> int:
    """Word edit distance by bit vectors: one column of the table is one big integer.

    Bit i of ``up`` / ``down`` says whether the column rises or falls between
    reference words i and i + 1; a hypothesis word costs a few integer operations.
    """
    size = len(ref)
    if size == 0:
        return len(hyp)
    where: dict[str, int] = {}
    for i, word in enumerate(ref):
        where[word] = where.get(word, 0) | (1 << i)
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    for word in hyp:
        equal = where.get(word, 0)
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(equal | down | rise)), rise & (equal | down)
    return score


def word_edits(ref: Column, hyp: Column) -> Column:
    """Word edit distance of two word arrays."""

    @F.pandas_udf("int")
    def distance(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        return pd.Series([_edits(r, h) for r, h in zip(refs, hyps)], dtype="int32")

    return distance(ref, hyp)


def wer_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp", words=normalize_words) -> DataFrame:
    """Add edits, n_ref and wer = edits / max(1, n_ref) of each pair of texts."""
    rows = df.withColumn("_r", words(F.col(ref))).withColumn("_h", words(F.col(hyp)))
    rows = rows.withColumn("edits", word_edits(F.col("_r"), F.col("_h"))).withColumn("n_ref", F.size("_r"))
    return rows.withColumn("wer", F.col("edits") / F.greatest(F.col("n_ref"), F.lit(1))).drop("_r", "_h")


def wer_summary(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Both rates in percent: the mean over files and total edits over total words."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.avg("wer")).alias("mean_wer"),
        (100 * F.sum("edits") / F.greatest(F.sum("n_ref"), F.lit(1))).alias("corpus_wer"))


def similarity_summary(pairs: DataFrame, by: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """Mean, minimum and count of the cosine of two vectors per setting."""
    rows = pairs.withColumn("_s", cosine(F.col(a), F.col(b)))
    return rows.groupBy(*by).agg(
        F.avg("_s").alias("mean_sim"), F.min("_s").alias("min_sim"), F.count(F.lit(1)).alias("n"))


def _binade(value: Column) -> Column:
    """A coarse monotone bin of a double: sign and power of two; nan above all, as Spark orders it."""
    power = F.least(F.greatest(F.floor(F.log2(F.abs(value))), F.lit(-1080)), F.lit(1024)) + F.lit(1100)
    return F.when(F.isnan(value), F.lit(6000)).when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("long") * power).cast("long")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float], bins: int = 256) -> DataFrame:
    """Linear-interpolated percentiles of the non-null values per key, as {out: share}.

    Exact selection by narrowing: every wanted rank has an interval that holds its value.
    A pass counts the interval's values by bin, map-side first, and the bin with the
    rank gives the next interval, from its least to its greatest value. The first bins are
    powers of two, the next ones equal parts, so a handful of passes ends with
    intervals of one value. Values are neither sorted nor shuffled; a pass sends a row per
    key, rank and bin.
    """
    keys = list(keys)
    rows = df.select(F.struct(*keys).alias("_key"), F.col(value).cast("double").alias("_v")).filter("_v is not null")
    at = {name: (F.col("_n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    ranks = F.array_distinct(F.concat(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()]))
    sizes = materialize(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")), "sizes")
    open_ = sizes.select("_key", F.explode(ranks).alias("_rank"), "_lo", "_hi", F.lit(0).cast("long").alias("_below"))
    found, cell = [], _binade(F.col("_v"))
    upto = W.partitionBy("_key", "_rank").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    while True:
        inside = rows.join(bounded_broadcast(open_, F.lit(256), SMALL), "_key").filter("_v between _lo and _hi")
        counted = inside.groupBy("_key", "_rank", "_below", cell.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        first = F.col("_below") + F.coalesce(F.sum("_c").over(upto), F.lit(0))
        state = counted.withColumn("_below", first).filter("_below <= _rank and _rank < _below + _c")
        state = materialize(state.select("_key", "_rank", "_lo", "_hi", "_below"), "narrowed")
        found.append(state.filter("_lo = _hi").select("_key", "_rank", F.col("_lo").alias("_value")))
        open_ = state.filter("_lo < _hi")
        if open_.isEmpty():
            break
        # The least value is in the first part and the greatest in the last: every pass splits.
        cell = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)).cast("long")
    chosen = reduce(DataFrame.unionByName, found).join(sizes.select("_key", "_n"), "_key")
    outs = []
    for name, a in at.items():
        low, high = (F.max(F.when(F.col("_rank") == end, F.col("_value"))) for end in (F.floor(a), F.ceil(a)))
        outs.append((low + (high - low) * F.max(a - F.floor(a))).alias(name))
    return chosen.groupBy("_key").agg(*outs).select("_key.*", *shares)


def timing_table(timings: DataFrame) -> DataFrame:
    """Per (grp, stage): n, cold seconds and warm mean, median, p95, max and real-time factor.

    Without a warm row all rows count as warm; the factor needs the audio length
    of every warm row. ``timings``: grp, stage, seconds, audio_seconds, file, cold, row_id.
    """
    keys = ["grp", "stage"]
    counts = timings.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("cold")).alias("_warm"),
        F.min_by("seconds", F.when(F.col("cold"), F.col("row_id"))).alias("cold"))
    rows = timings.select(*keys, "seconds", "audio_seconds", "row_id", F.col("cold").alias("_cold")).join(
        bounded_broadcast(counts.select(*keys, "_warm"), F.lit(128), SMALL), keys)
    warm = rows.filter(~F.col("_cold") | (F.col("_warm") == 0))
    heard = F.when(F.col("audio_seconds") > 0, F.col("audio_seconds"))
    stats = warm.groupBy(*keys).agg(
        F.avg("seconds").alias("warm_mean"), F.max("seconds").alias("warm_max"),
        F.when(F.count(heard) == F.count(F.lit(1)), F.sum("seconds") / F.sum(heard)).alias("warm_rtf"))
    ranks = exact_percentiles(warm, keys, "seconds", {"warm_median": 0.5, "warm_p95": 0.95})
    return counts.drop("_warm").join(stats, keys).join(ranks, keys, "left")


def audio_summary(timings: DataFrame) -> DataFrame:
    """One row over the distinct (file, audio length): n, shortest, longest, mean."""
    files = timings.filter(F.col("file").isNotNull() & (F.col("audio_seconds") > 0)).select(
        "file", "audio_seconds").distinct()
    return files.agg(F.count(F.lit(1)).alias("n"), F.min("audio_seconds").alias("shortest"),
                     F.max("audio_seconds").alias("longest"), F.avg("audio_seconds").alias("mean"))


def cost_table(timings: DataFrame, prices: Mapping[str, float], prefix: str = "end to end ",
               total: str = "TOTAL") -> DataFrame:
    """Warm real-time factor, audio hours per hour and cost per audio hour of each setting.

    Only prices named ``*_usd_per_hour`` count; without any the result is empty.
    """
    hourly = sum(v for k, v in prices.items() if k.endswith("_usd_per_hour"))
    rows = timings.filter(
        (F.col("stage") == total) & ~F.col("cold") & (F.col("audio_seconds") > 0)
        & F.startswith("grp", F.lit(prefix.strip())) & F.lit(hourly > 0))
    rtf = F.sum("seconds") / F.sum("audio_seconds")
    return rows.groupBy(F.replace("grp", F.lit(prefix), F.lit("")).alias("setting")).agg(rtf.alias("rtf")).select(
        "setting", "rtf", (1 / F.col("rtf")).alias("audio_hours_per_hour"),
        (hourly * F.col("rtf")).alias("cost_per_hour"), (1000 * hourly * F.col("rtf")).alias("cost_per_1000_hours"))


def evaluate_checks(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """check, metric, value, status, detail from threshold rules.

    ``rules``: metric, low, high, otherwise; a value strictly between the bounds
    passes (null means no bound), any other gets the ``otherwise`` status. NaN
    and null values pass, as there is nothing to judge.
    """
    table = bounded_broadcast(rules, F.lit(256), SMALL)
    inside = (F.col("low").isNull() | (F.col("value") > F.col("low"))) & (
        F.col("high").isNull() | (F.col("value") < F.col("high")))
    status = F.when(F.col("value").isNull() | F.isnan("value") | inside, "PASS").otherwise(F.col("otherwise"))
    detail = F.format_string("%s=%.3f", "metric", F.col("value"))
    return metrics.join(table, "metric").select("check", "metric", "value", status.alias("status"), detail.alias("detail"))


def status_totals(checks: DataFrame) -> DataFrame:
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sweep_best(scores: DataFrame, settings: Sequence[str], value: str = "similarity") -> DataFrame:
    """Settings with rounded mean and minimum score, best first (rank from 0)."""
    table = scores.groupBy(*settings).agg(
        F.round(F.avg(value), 3).alias("mean_sim"), F.round(F.min(value), 3).alias("min_sim"))
    return number_rows(table, [-F.col("mean_sim"), *[F.col(s) for s in settings]], out="rank")


def first_k_per_group(df: DataFrame, group: str, source: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows per group in order, at most one per source.

    A rank bound lets Spark keep only ``k`` rows per group in each map task, so
    a large group is cut before the shuffle.
    """
    once = df.withColumn("_r", F.row_number().over(W.partitionBy(group, source).orderBy(order))).filter("_r = 1")
    ranked = once.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(order)))
    return ranked.filter(F.col("_r") <= k).drop("_r")


def stage_shares(timings: DataFrame, merged: Mapping[str, str] | None = None) -> DataFrame:
    """Seconds and share of the total per stage; ``merged`` renames stages first."""
    stage = F.col("stage")
    for old, new in (merged or {}).items():
        stage = F.when(F.col("stage") == old, new).otherwise(stage)
    sums = timings.groupBy(stage.alias("stage")).agg(F.sum("seconds").alias("seconds"))
    total = timings.agg(F.sum("seconds").alias("t")).scalar()
    return sums.withColumn("share", F.col("seconds") / total)


def same_output(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b, and whether both are equal as multisets."""
    only_a = a.exceptAll(b).select(F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    only_b = b.exceptAll(a).select(F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    counts = only_a.unionByName(only_b).agg(
        F.coalesce(F.sum("in_a"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("in_b"), F.lit(0)).alias("only_b"))
    return counts.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def mean_l1(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("utt_id",), value: str = "f0") -> DataFrame:
    """Mean absolute difference per recording over the shorter length."""
    both = a.select(*keys, "frame", F.col(value).alias("_a")).join(
        b.select(*keys, "frame", F.col(value).alias("_b")), [*keys, "frame"])
    return both.groupBy(*keys).agg(F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("l1"))


def pool_report(pool: DataFrame, by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Size, vector lengths and genders of each part of the pool."""
    dim = F.size("xvector")
    return pool.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(dim).alias("min_dim"), F.max(dim).alias("max_dim"),
        F.count_if(F.col("gender") == "f").alias("n_f"), F.count_if(F.col("gender") == "m").alias("n_m"))
