"""F0 and other numeric series, one row per (recording, frame)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions import rng
from framewright.operators.scans import (
    BLOCK, scan, with_lag_lead, with_neighbours, with_totals)

# Fixed values of the data model.
PITCH_MEAN = 61.64
PITCH_STD = 67.5
XVECTOR_SCALE = 20.0
LOG_FLOOR = 1e-5
LOW_F0 = 20.0
PEAK_LEVEL = 0.95
F0_EDGES = (10.0, 100.89050217, 115.1907547, 127.34055481, 142.26394958, 161.6648941,
            180.98721313, 199.32779541, 221.38771667, 252.21411438, 803.56750488)


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def resample_linear(
    df: DataFrame, n: Column | int, keys="utt_id", value: str = "f0", clamp_end: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Linear resampling of each series to ``n`` points, end points included.

    Every source frame emits the target points between itself and the next
    frame, so there is neither a spine nor a position join. ``clamp_end`` places
    the points on ``0 .. length`` and holds the last value, as an audio loader does.
    """
    keys = _keys(keys)
    n = F.lit(n) if isinstance(n, int) else n
    rows = with_totals(df.withColumn("_n", n.cast("bigint")), keys,
                       [F.count(F.lit(1)).alias("_m")], block=block)
    rows = with_lag_lead(rows, keys, lead={"_next": value}, block=block)
    span = F.col("_m") if clamp_end else F.col("_m") - 1
    rows = rows.withColumn("_span", span.cast("bigint")).withColumn("_den", F.col("_n") - 1)
    # Target i sits at i * span / (n - 1); frame j owns the targets with floor(position) = j.
    first = F.expr("(frame * _den + _span - 1) div _span")
    stop = F.expr("((frame + 1) * _den + _span - 1) div _span - 1")
    rows = rows.withColumn("_lo", F.when(F.col("_span") == 0, 0).otherwise(
        F.when(F.col("_den") == 0, F.col("frame")).otherwise(first)))
    rows = rows.withColumn("_hi", F.when(F.col("_next").isNull(), F.col("_den")).otherwise(
        F.when(F.col("_den") == 0, -1).otherwise(stop)))
    rows = rows.withColumn("_hi", F.when(
        (F.col("_den") == 0) & (F.col("frame") == 0), 0).otherwise(F.col("_hi")))
    rows = rows.filter((F.col("_lo") <= F.col("_hi")) & (F.col("_n") > 0))
    rows = rows.withColumn("_i", F.explode(F.sequence("_lo", "_hi")))
    frac = F.when(F.col("_next").isNull() | (F.col("_den") == 0), 0.0).otherwise(
        F.expr("(_i * _span - frame * _den) / cast(_den as double)"))
    out = F.col(value) + frac * (F.coalesce("_next", value) - F.col(value))
    return rows.select(*keys, F.col("_i").alias("frame"), out.alias(value))


def convert_pitch(
    df: DataFrame, target_mean: Column, target_std: Column, keys="utt_id", flatten: bool = False,
    eps: float = 1e-8, block: int = BLOCK,
) -> DataFrame:
    """Move voiced log F0 to a target mean and deviation; zeros stay zero."""
    rows = df.withColumn("_tm", target_mean).withColumn("_ts", target_std)
    voiced = F.col("f0") != 0
    if flatten:
        return rows.withColumn("f0", F.when(voiced, F.exp("_tm")).otherwise(0.0)).drop("_tm", "_ts")
    log_f0 = F.when(voiced, F.log("f0"))
    rows = with_totals(rows, keys, [F.avg(log_f0).alias("_m"), F.stddev_pop(log_f0).alias("_s")],
                       block=block)
    moved = moved_pitch(F.col("f0"), F.col("_m"), F.col("_s"), F.col("_tm"), F.col("_ts"), eps)
    return rows.withColumn("f0", moved).drop("_m", "_s", "_tm", "_ts")


def moved_pitch(f0: Column, mean: Column, std: Column, target_mean: Column, target_std: Column, eps: float = 1e-8) -> Column:
    """F0 of known log statistics at a target mean and deviation; zeros stay zero."""
    score = (F.log(f0) - mean) / F.greatest(std, F.lit(eps))
    return F.when(f0 != 0, F.exp(score * target_std + target_mean)).otherwise(0.0)


def match_own_pitch(df: DataFrame, reference: DataFrame, keys="utt_id", eps: float = 1e-8,
                    block: int = BLOCK) -> DataFrame:
    """Convert each series to the log statistics of the same key's reference series."""
    from framewright.operators.scans import attach

    keys = _keys(keys)
    log_f0 = F.when(F.col("f0") != 0, F.log("f0"))
    stats = reference.groupBy(*keys).agg(
        F.avg(log_f0).alias("ref_m"), F.stddev_pop(log_f0).alias("ref_s"))
    rows = attach(df, stats, keys, block=block)
    out = convert_pitch(rows, F.col("ref_m"), F.col("ref_s"), keys, eps=eps, block=block)
    return out.drop("ref_m", "ref_s")


def smooth_voiced(df: DataFrame, n: int = 32, a: float = 0.75, keys="utt_id",
                  block: int = BLOCK) -> DataFrame:
    """Blend voiced F0 with its moving average over the voiced frames only.

    The kernel has ``min(n, voiced frames)`` points, zero padding at both ends
    and a constant divisor. Keys with fewer than ``n`` voiced frames fit into one
    small array; all others use a ROWS frame over the voiced rank.
    """
    if a == 0.0:
        return df
    keys = _keys(keys)
    one = F.lit(1).cast("bigint")
    ranked = scan(df.filter(F.col("f0") != 0), keys, sums={"_rank": one}, totals={"_v": ("sum", one)}, block=block,
                  inclusive=False)
    long_keys = with_neighbours(
        ranked.filter(F.col("_v") >= n), keys,
        {"_ma": lambda w: F.sum("f0").over(w.rowsBetween(-(n // 2), n - n // 2 - 1)) / F.lit(float(n))},
        before=n // 2, after=n - n // 2 - 1, pos="_rank", block=block)
    fields = [c for c in ranked.columns if c not in keys]
    # At most n - 1 rows per key here, so the array is bounded by the kernel.
    short_keys = (
        ranked.filter(F.col("_v") < n).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("_rank", *[c for c in fields if c != "_rank"]))).alias("_all"))
        .withColumn("_row", F.explode("_all"))
        .withColumn("_k", F.col("_row._v"))
        .withColumn("_from", F.greatest(F.expr("_row._rank - _k div 2"), F.lit(0)))
        .withColumn("_to", F.least(F.expr("_row._rank + _k - _k div 2 - 1"), F.col("_k") - 1))
        .withColumn("_ma", F.aggregate(
            F.slice("_all", (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from") + 1).cast("int")),
            F.lit(0.0), lambda acc, x: acc + x["f0"]) / F.col("_k"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in fields], "_ma")
    )
    smoothed = long_keys.unionByName(short_keys).withColumn(
        "f0", (1.0 - a) * F.col("f0") + a * F.col("_ma"))
    return smoothed.select(*df.columns).unionByName(df.filter(F.col("f0") == 0))


def add_noise(df: DataFrame, level: float, seed: Column | int, keys="utt_id", snr_db: bool = False,
              block: int = BLOCK) -> DataFrame:
    """Gaussian noise on voiced frames, power = mean square / level, clipped at zero.

    ``level`` divides linearly; ``snr_db=True`` reads it as decibels.
    """
    if level == 0:
        return df
    keys = _keys(keys)
    divisor = 10 ** (level / 10) if snr_db else level
    voiced = F.col("f0") != 0
    rows = with_totals(df, keys, [F.avg(F.when(voiced, F.col("f0") ** 2)).alias("_power")], block=block)
    noise = F.sqrt(F.col("_power") / divisor) * rng.normal(seed, *[F.col(k) for k in keys], F.col("frame"))
    return rows.withColumn(
        "f0", F.when(voiced, F.greatest(F.col("f0") + noise, F.lit(0.0))).otherwise(F.col("f0"))
    ).drop("_power")


def f0_stats(df: DataFrame) -> DataFrame:
    """One row: mean and population deviation of all voiced values (training statistics)."""
    voiced = F.when(F.col("f0") != 0, F.col("f0"))
    return df.agg(F.avg(voiced).alias("mean"), F.stddev_pop(voiced).alias("std"))


def standardize_f0(df: DataFrame, target_mean: float = 100.0, keys="utt_id", block: int = BLOCK) -> DataFrame:
    """Scale each key's voiced mean to ``target_mean``, then apply the global z-score to all frames."""
    stats = f0_stats(df)
    voiced = F.col("f0") != 0
    rows = with_totals(df, keys, [F.avg(F.when(voiced, F.col("f0"))).alias("_mean")], block=block)
    scaled = F.when(voiced, F.col("f0") * (target_mean / F.col("_mean"))).otherwise(F.col("f0"))
    return rows.withColumn(
        "f0", (scaled - stats.select("mean").scalar()) / stats.select("std").scalar()).drop("_mean")


def destandardize_f0(df: DataFrame, mean: Column, std: Column, floor: float = LOW_F0) -> DataFrame:
    """Undo the z-score and set values under the floor to unvoiced."""
    raw = F.col("f0") * std + mean
    return df.withColumn("f0", F.when(raw < floor, 0.0).otherwise(raw))


def normalize_inputs(df: DataFrame) -> DataFrame:
    """Constant normalization of ``f0`` and, when present, of ``xvector``."""
    if "f0" in df.columns:
        df = df.withColumn("f0", (F.col("f0") - PITCH_MEAN) / PITCH_STD)
    if "xvector" in df.columns:
        df = df.withColumn("xvector", F.transform("xvector", lambda x: x / XVECTOR_SCALE))
    return df


def bucketize(col: Column, edges: Sequence[float] = F0_EDGES) -> Column:
    """Number of edges that are not above the value."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.when(col >= F.lit(float(edge)), 1).otherwise(0)
    return total


def hann(pos: Column, size: int) -> Column:
    """Symmetric Hann window of ``size`` points."""
    return F.lit(0.5) - F.lit(0.5) * F.cos(2.0 * F.pi() * pos / F.lit(float(size - 1)))


def overlap_add(
    df: DataFrame, chunk: int = 200, overlap: int | None = None, keys="utt_id", value: str = "f0",
    fn: Callable[[DataFrame], DataFrame] | None = None, rate: int = 1, block: int = BLOCK,
) -> DataFrame:
    """Run ``fn`` on overlapping chunks and merge its output with a Hann window.

    ``fn`` gets rows (keys, chunk_no, pos, value), with zero rows padding the
    last chunks, and returns ``rate`` rows per input row under the same columns.
    Series of at most one chunk pass through ``fn`` without a window. Positions
    whose weights sum to zero keep weight one.
    """
    keys = _keys(keys)
    step = chunk - (chunk // 2 if overlap is None else overlap)
    rows = with_totals(df, keys, [F.count(F.lit(1)).alias("_n")], block=block)
    lowest = F.expr(f"case when _n <= {chunk} then 0 else greatest(frame - {chunk - 1} + {step - 1}, 0) div {step} end")
    highest = F.expr(f"case when _n <= {chunk} then 0 else frame div {step} end")
    chunks = (
        rows.withColumn("chunk_no", F.explode(F.sequence(lowest, highest)))
        .withColumn("pos", F.col("frame") - F.col("chunk_no") * step)
        .select(*keys, "_n", "chunk_no", "pos", F.col(value).cast("double").alias(value))
    )
    # Chunk starts run up to the last frame, so several chunks may reach past the end.
    lengths = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > chunk)
    pads = (
        lengths.withColumn("chunk_no", F.explode(F.sequence(
            F.expr(f"greatest((_n - {chunk}) div {step}, 0)"), F.expr(f"(_n - 1) div {step}"))))
        .filter(F.col("chunk_no") * step + chunk > F.col("_n"))
        .withColumn("pos", F.explode(F.sequence(
            F.col("_n") - F.col("chunk_no") * step, F.lit(chunk - 1).cast("bigint"))))
        .select(*keys, "_n", "chunk_no", "pos", F.lit(0.0).alias(value))
    )
    out = chunks.unionByName(pads)
    if fn is not None:
        out = fn(out)
    weight = F.when(F.col("_n") <= chunk, 1.0).otherwise(hann(F.col("pos"), chunk * rate))
    merged = (
        out.withColumn("frame", F.col("chunk_no") * (step * rate) + F.col("pos"))
        .filter(F.col("frame") < F.col("_n") * rate)
        .withColumn("_w", weight)
        .groupBy(*keys, "frame")
        .agg(F.sum(F.col("_w") * F.col(value)).alias("_y"), F.sum("_w").alias("_w"))
    )
    return merged.select(
        *keys, "frame", (F.col("_y") / F.when(F.col("_w") == 0, 1.0).otherwise(F.col("_w"))).alias(value))


def log_compress(col: Column, scale: float = 1.0, floor: float = LOG_FLOOR) -> Column:
    return F.log(F.greatest(col, F.lit(floor)) * scale)


def log_expand(col: Column, scale: float = 1.0) -> Column:
    return F.exp(col) / scale


def peak_normalize(df: DataFrame, keys="utt_id", value: str = "f0", level: float = PEAK_LEVEL,
                   block: int = BLOCK) -> DataFrame:
    """Scale each series so that its largest magnitude is ``level``; silence stays."""
    rows = with_totals(df, keys, [F.max(F.abs(value)).alias("_peak")], block=block)
    scaled = F.col(value) / F.when(F.col("_peak") > 0, F.col("_peak")).otherwise(1.0) * level
    return rows.withColumn(value, scaled).drop("_peak")


def series_sanity(df: DataFrame, reference: DataFrame, keys="utt_id", value: str = "sample",
                  rate: str = "rate", expected_rate: int = 16000, channels: str | None = None) -> DataFrame:
    """Problems of each series as an array of codes; an empty array means it is fine.

    ``reference`` has the keys and ``ref_seconds``. ``channels`` names a column with
    the number of channels, which must be one. Codes: rate:<found>, channels:<found>,
    non_finite, silent, clipped, duration.
    """
    keys = _keys(keys)
    x = F.col(value)
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    stats = df.groupBy(*keys).agg(
        F.max(rate).alias("rate"), F.max(F.col(channels) if channels else F.lit(1)).alias("channels"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(finite, 0).otherwise(1)).alias("n_bad"),
        F.sqrt(F.avg(x * x)).alias("rms"),
        F.avg(F.when(F.abs(x) > 0.999, 1.0).otherwise(0.0)).alias("clipped"))
    ratio = F.col("n") / F.col("rate") / F.col("ref_seconds")
    found = F.array_compact(F.array(
        F.when(F.col("rate") != expected_rate, F.concat(F.lit("rate:"), F.col("rate").cast("string"))),
        F.when(F.col("channels") != 1, F.concat(F.lit("channels:"), F.col("channels").cast("string"))),
        F.when(F.col("n_bad") > 0, "non_finite"),
        F.when(F.col("rms") < 1e-3, "silent"),
        F.when(F.col("clipped") > 0.01, "clipped"),
        F.when(~((ratio > 0.9) & (ratio < 1.1)), "duration")))
    return stats.join(reference, keys, "left").select(*keys, found.alias("problems"))
