"""Outputs: keyed result tables, frame payloads, file lists and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, partition: str = "batch") -> None:
    """Result table partitioned by ``partition``; writing a partition again replaces it."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_payload(frames: DataFrame, path: str, width: int = 65536) -> None:
    """Frame table clustered by recording; long recordings are cut so that no file holds one whole."""
    (frames.repartition("utt_id", F.expr(f"frame div {width}"))
     .sortWithinPartitions("utt_id", "frame").write.mode("overwrite").parquet(path))


def read_payload(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def filelist_lines(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("|", "path", "text").alias("value"))


def write_filelist(df: DataFrame, path: str) -> None:
    filelist_lines(df).write.mode("overwrite").text(path)


def report_lines(checks: DataFrame) -> DataFrame:
    """Markdown table rows of checks (check, status, detail, metrics map)."""
    metrics = F.array_join(F.transform(
        F.array_sort(F.map_entries("metrics")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return checks.select(F.format_string("| %s | %s | %s | %s |", "check", "status", "detail", metrics).alias("value"))


def write_report(checks: DataFrame, timings: DataFrame, path: str) -> None:
    """``report`` and ``timings`` as JSON, the markdown rows as text."""
    checks.write.mode("overwrite").json(f"{path}/report")
    timings.write.mode("overwrite").json(f"{path}/timings")
    report_lines(checks).write.mode("overwrite").text(f"{path}/markdown")
