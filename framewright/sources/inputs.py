"""Inputs: lists, folders, manifests, transcripts, file lists, sidecars and raw matrices."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.text import strip
from framewright.operators.corpus import stem
from framewright.operators.scans import number_rows

MANIFEST = "path string, sentence string, language string, alignments array<double>"


def clean_input_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trimmed lines without blank ones and ``#`` comments."""
    return lines.withColumn(col, strip(F.col(col))).filter((F.col(col) != "") & ~F.startswith(col, F.lit("#")))


def read_input_list(spark: SparkSession, path: str) -> DataFrame:
    """List file to one row per path."""
    return clean_input_lines(spark.read.text(path)).withColumnRenamed("value", "path")


def collect_inputs(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of sources (path, pos) that keeps the first place of each path: path, rank."""
    tagged = [s.select("path", F.struct(F.lit(i).alias("source"), F.col("pos").cast("bigint").alias("pos")).alias("_at"))
              for i, s in enumerate(sources)]
    union = tagged[0]
    for part in tagged[1:]:
        union = union.unionByName(part)
    first = union.groupBy("path").agg(F.min("_at").alias("_at"))
    return number_rows(first, [F.col("_at.source"), F.col("_at.pos"), F.col("path")], out="rank").select("path", "rank")


def scan_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, length and modificationTime of the matching files; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower()).load(folder)
        .select("path", "length", "modificationTime")
    )


def decode_raw_matrix(files: DataFrame, cols: int, dtype: str = "f4", endian: str = "little",
                      content: str = "content") -> DataFrame:
    """Binary N x ``cols`` matrices to one row per frame: other columns, frame, values."""
    kind = {"little": "<", "big": ">", "native": "="}[endian] + dtype

    @F.pandas_udf("array<array<double>>")
    def decode(col: pd.Series) -> pd.Series:
        def matrix(raw):
            row = cols * np.dtype(kind).itemsize
            flat = np.frombuffer(raw[: len(raw) // row * row], dtype=kind)  # a torn last row is left out
            return list(flat.reshape(-1, cols).astype(np.float64))

        return col.map(matrix)

    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(decode(F.col(content))).alias("frame", "values"))


def read_raw_matrix(spark: SparkSession, path: str, cols: int, dtype: str = "f4", endian: str = "little",
                    pattern: str = "*") -> DataFrame:
    """utt (file stem), frame, values of the raw matrices in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.select(stem(F.col("path")).alias("utt"), "content")
    return decode_raw_matrix(named, cols, dtype, endian)


def read_manifests(spark: SparkSession, files: Sequence[tuple[str, str]]) -> DataFrame:
    """JSON manifests (arrays of objects), each tagged with its prefix."""
    union = None
    for path, prefix in files:
        part = spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("prefix", F.lit(prefix))
        union = part if union is None else union.unionByName(part)
    return union


def parse_transcripts(lines: DataFrame, root: str, suffix: str = ".opus") -> DataFrame:
    """Lines ``id<TAB>text`` to audio_id, path, sentence; the path follows from the parts of the id."""
    cells = F.split(strip(F.col("value")), "\t")
    audio = F.get(cells, 0)
    parts = F.split(audio, "_")
    return lines.select(
        audio.alias("audio_id"),
        F.concat_ws("/", F.lit(root), F.lit("audio"), F.get(parts, 0), F.get(parts, 1),
                    F.concat(audio, F.lit(suffix))).alias("path"),
        F.get(cells, 1).alias("sentence"))


def read_transcripts(spark: SparkSession, folder: str, suffix: str = ".opus") -> DataFrame:
    return parse_transcripts(spark.read.text(f"{folder}/transcripts.txt"), folder, suffix)


def parse_filelist(lines: DataFrame) -> DataFrame:
    """Lines ``path|text`` to path, text; empty lines are left out."""
    cells = F.split(F.col("value"), r"\|", 2)
    return lines.filter(F.length("value") > 0).select(F.get(cells, 0).alias("path"), F.get(cells, 1).alias("text"))


def read_filelist(spark: SparkSession, path: str) -> DataFrame:
    return parse_filelist(spark.read.text(path))


def attach_sidecar(utts: DataFrame, meta: DataFrame, limit: int | None = None) -> DataFrame:
    """Left join by file stem; the first ``limit`` recordings in path order.

    ``meta``: path and any fields; with several files of one stem the first path counts.
    """
    fields = [c for c in meta.columns if c != "path"]
    if limit is not None:
        utts = utts.orderBy("path").limit(limit)
    first = meta.groupBy(stem(F.col("path")).alias("_stem")).agg(
        F.min_by(F.struct(*fields), F.col("path")).alias("_m"))
    joined = utts.withColumn("_stem", stem(F.col("path"))).join(first, "_stem", "left")
    return joined.select(*utts.columns, *[F.col(f"_m.{c}").alias(c) for c in fields])


def parse_speaker_genders(lines: DataFrame) -> DataFrame:
    """Lines ``speaker gender`` to speaker_id, gender."""
    cells = F.split(strip(F.col("value")), r"[ \t]+")
    return lines.filter(strip(F.col("value")) != "").select(
        F.get(cells, 0).alias("speaker_id"), F.get(cells, 1).alias("gender"))


def parse_pool_pitch(texts: DataFrame, col: str = "value") -> DataFrame:
    """JSON maps ``{speaker: [mean, std, weight]}`` to speaker_id, m, s, w."""
    entries = F.explode(F.from_json(F.col(col), "map<string, array<double>>")).alias("speaker_id", "_v")
    return texts.select(entries).select(
        "speaker_id", F.get("_v", 0).alias("m"), F.get("_v", 1).alias("s"), F.get("_v", 2).alias("w"))


def load_pool(speakers: DataFrame, xvectors: DataFrame, clusters: DataFrame, pitch: DataFrame) -> DataFrame:
    """speaker_id, gender, cluster, xvector, m, s, w of the speakers known to all four tables."""
    return (
        speakers.select("speaker_id", "gender").join(xvectors.select("speaker_id", "xvector"), "speaker_id")
        .join(clusters.select("speaker_id", "cluster"), "speaker_id")
        .join(pitch.select("speaker_id", "m", "s", "w"), "speaker_id")
    )


def vector_dims(df: DataFrame, col: str = "xvector") -> DataFrame:
    """How many vectors have which length."""
    return df.groupBy(F.size(col).alias("dim")).agg(F.count(F.lit(1)).alias("n"))


def assert_same_dim(df: DataFrame, col: str = "xvector") -> DataFrame:
    """The table itself if all vectors have one length, an error otherwise."""
    dims = [r["dim"] for r in vector_dims(df, col).limit(10).collect()]
    if len(dims) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(dims)}")
    return df


def missing_files(expected: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """Expected entries that are not present."""
    return expected.join(present.select(key).distinct(), key, "left_anti")


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def verify_checksums(files: DataFrame, sums: DataFrame) -> DataFrame:
    """path, status of every manifest entry: ``ok``, ``mismatch`` or ``missing``.

    ``files``: path, and digest (``binary.digest_files``, for files of any size) or
    content. ``sums``: path, digest.
    """
    found = files.select("path", (F.col("digest") if "digest" in files.columns else digest(F.col("content"))).alias("_found"))
    status = F.when(F.col("_found").isNull(), "missing").when(
        F.col("_found") == F.col("digest"), "ok").otherwise("mismatch")
    return sums.join(found, "path", "left").select("path", status.alias("status"))
