"""Corpus rows: column selection, result names, label masks and language routing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.scans import bounded_broadcast

IGNORED = -100


def stem(path: Column) -> Column:
    """File name without folders and extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def safe_stem(path: Column) -> Column:
    return F.replace(stem(path), F.lit(" "), F.lit("_"))


def result_name(path: Column, ratio: Column, seed: Column, gender: Column) -> Column:
    """``<stem>_seed<seed>_<gender>_adm<ratio>`` with three digits and ``p`` for the point."""
    share = F.replace(F.format_string("adm%.3f", ratio.cast("double")), F.lit("."), F.lit("p"))
    return F.concat_ws("_", safe_stem(path), F.concat(F.lit("seed"), seed.cast("string")),
                       F.coalesce(F.when(gender != "", gender), F.lit("rand")), share)


def pair_published(originals: DataFrame, published: DataFrame) -> DataFrame:
    """path, published, seed: the first published clip of each original, by name.

    Published clips are called ``<stem>_seed_<number>_anon.wav``; an original's stem
    is its file name without the extension and without ``_orig``. Originals without
    a clip are left out; clips with another name belong to none.
    """
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    clips = published.select(
        "path", F.regexp_extract(name, r"^(.*)_seed_(\d+)_anon\.wav$", 1).alias("_stem"),
        F.regexp_extract(name, r"^(.*)_seed_(\d+)_anon\.wav$", 2).alias("_seed")).filter("_seed <> ''")
    first = clips.groupBy("_stem").agg(F.min(F.struct("path", "_seed")).alias("_clip"))
    rows = originals.select("path", F.replace(stem(F.col("path")), F.lit("_orig"), F.lit("")).alias("_stem"))
    return rows.join(first, "_stem").select(
        "path", F.col("_clip.path").alias("published"), F.col("_clip._seed").cast("bigint").alias("seed"))


def select_corpus(df: DataFrame, drop: Sequence[str] = (), casts: Mapping[str, str] | None = None) -> DataFrame:
    """Drop columns and cast others."""
    df = df.drop(*drop)
    for name, kind in (casts or {}).items():
        df = df.withColumn(name, F.col(name).cast(kind))
    return df


def mask_labels(df: DataFrame, bos: int, ids: str = "ids", length: str = "length",
                batch: str | None = None) -> DataFrame:
    """Padding (behind ``length``) becomes -100; a batch that starts with ``bos`` everywhere loses it."""
    masked = F.concat(F.slice(ids, F.lit(1), F.col(length)),
                      F.array_repeat(F.lit(IGNORED), F.size(ids) - F.least(F.size(ids), F.col(length))))
    df = df.withColumn(ids, masked)
    if batch is None:
        first = df.agg(F.bool_and(F.col(ids)[0] == bos).alias("b")).scalar()
        return df.withColumn(ids, F.when(first, F.slice(ids, F.lit(2), F.size(ids))).otherwise(F.col(ids)))
    flags = df.groupBy(batch).agg(F.bool_and(F.col(ids)[0] == bos).alias("_cut"))
    df = df.join(bounded_broadcast(flags, F.lit(64), 64 << 20), batch)
    return df.withColumn(ids, F.when(F.col("_cut"), F.slice(ids, F.lit(2), F.size(ids))).otherwise(F.col(ids))).drop("_cut")


def unmask_labels(col: Column, pad: int) -> Column:
    return F.transform(col, lambda x: F.when(x == IGNORED, pad).otherwise(x))


def route_language(df: DataFrame, supported: Mapping[str, str], lang: str = "lang") -> DataFrame:
    """Add ``route`` for supported languages and an error text for the others."""
    route = F.lit(None).cast("string")
    for name, target in supported.items():
        route = F.when(F.lower(lang) == name, target).otherwise(route)
    df = df.withColumn("route", route)
    return df.withColumn("error", F.when(F.col("route").isNull(), F.concat(
        F.lit("Language "), F.coalesce(lang, F.lit("?")), F.lit(" not supported"))))
