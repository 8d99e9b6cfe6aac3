"""Large binary files as Spark data sources: byte ranges of matrices, digests in constant memory.

``raw_matrix`` deals the row ranges of all files to tasks, so one large file is read by
many and many small files by one; no task holds a file. ``file_digest`` streams every file
once through its hash. Files are opened where they are read, by their URI or local path.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

#: Bytes of a task's ranges; what opening a file counts as; bytes read at once.
SPLIT_BYTES, OPEN_BYTES, CHUNK_BYTES = 128 << 20, 1 << 20, 4 << 20


def open_store(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    local = path.removeprefix("file:")
    return fs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else local


def list_files(path: str, pattern: str = "*", recursive: bool = False) -> list[tuple[str, int]]:
    """(path, size) of the files whose name matches; hidden ones are left out. Names and sizes only."""
    from pyarrow import fs

    store, root = open_store(path)
    info = store.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=recursive))
    prefix = path[: len(path) - len(root)] if "://" in path else ""
    return sorted((prefix + f.path, f.size) for f in found
                  if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and f.base_name[0] not in "._")


@dataclass
class Ranges(InputPartition):
    """(path, first row or byte, number) of each piece of one task."""

    pieces: list[tuple[str, int, int]]


def deal(pieces: Iterator[tuple[str, int, int]], width: int, split_bytes: int) -> list[Ranges]:
    """Pieces in partitions of about ``split_bytes``."""
    out, held = [Ranges([])], 0
    for path, first, n in pieces:
        if out[-1].pieces and held + n * width > split_bytes:
            out.append(Ranges([]))
            held = 0
        out[-1].pieces.append((path, first, n))
        held += n * width + OPEN_BYTES
    return out


def file_stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0] or path.rsplit("/", 1)[-1]


class RawMatrixReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.cols = options["path"], int(options["cols"])
        kind = {"little": "<", "big": ">", "native": "="}[options.get("endian", "little")] + options.get("dtype", "f4")
        self.kind, self.pattern = np.dtype(kind), options.get("pattern", "*")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.split_bytes, self.wanted = int(options.get("splitbytes", SPLIT_BYTES)), None
        self.row_bytes = self.cols * self.kind.itemsize

    def pushFilters(self, filters):
        """Files of other recordings are not opened."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) and f.attribute == ("utt",) else set(f.value) if isinstance(f, In) and f.attribute == ("utt",) else None
            if names is None:
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self):
        def pieces():
            most = max(1, self.split_bytes // self.row_bytes)
            for path, size in list_files(self.path, self.pattern, self.recursive):
                if self.wanted is None or file_stem(path) in self.wanted:
                    rows = size // self.row_bytes  # a torn last row is left out
                    for first in range(0, rows, most):
                        yield path, first, min(most, rows - first)

        return deal(pieces(), self.row_bytes, self.split_bytes)

    def read(self, partition):
        import pyarrow as pa

        some = max(1, CHUNK_BYTES // self.row_bytes)
        for path, first, n in partition.pieces:
            store, at = open_store(path)
            with store.open_input_file(at) as file:
                for row in range(first, first + n, some):
                    many = min(some, first + n - row)
                    flat = np.frombuffer(file.read_at(many * self.row_bytes, row * self.row_bytes), self.kind).astype(np.float64)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(many + 1) * self.cols, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array([file_stem(path)] * many), pa.array(np.arange(row, row + many)), values], ["utt", "frame", "values"])


class RawMatrix(DataSource):
    """One row per frame of N x ``cols`` matrices. Options: path, cols, dtype, endian, pattern, recursive, splitBytes."""

    @classmethod
    def name(cls):
        return "raw_matrix"

    def schema(self):
        return "utt string, frame bigint, values array<double>"

    def reader(self, schema):
        return RawMatrixReader(self.options)


class FileDigestReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.pattern, self.method = options["path"], options.get("pattern", "*"), options.get("method", "sha256")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.split_bytes = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        return deal(((path, 0, size) for path, size in list_files(self.path, self.pattern, self.recursive)), 1, self.split_bytes)

    def read(self, partition):
        import pyarrow as pa

        for path, _, size in partition.pieces:
            store, at = open_store(path)
            digest = hashlib.new(self.method)
            with store.open_input_stream(at) as file:
                while chunk := file.read(CHUNK_BYTES):
                    digest.update(chunk)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([digest.hexdigest()])], ["path", "length", "digest"])


class FileDigest(DataSource):
    """One row per file with its hash. Options: path, pattern, recursive, method, splitBytes."""

    @classmethod
    def name(cls):
        return "file_digest"

    def schema(self):
        return "path string, length bigint, digest string"

    def reader(self, schema):
        return FileDigestReader(self.options)


def read_matrix_ranges(spark: SparkSession, path: str, cols: int, dtype: str = "f4", endian: str = "little", pattern: str = "*",
                       recursive: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """utt (file stem), frame, values of the raw matrices in a folder, read by byte ranges."""
    spark.dataSource.register(RawMatrix)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # off by default; the reader takes filters on utt
    return (spark.read.format("raw_matrix").option("cols", cols).option("dtype", dtype).option("endian", endian).option("pattern", pattern)
            .option("recursive", str(recursive)).option("splitBytes", split_bytes).load(path))


def digest_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False, method: str = "sha256") -> DataFrame:
    """path, length, digest of every file of a folder."""
    spark.dataSource.register(FileDigest)
    return spark.read.format("file_digest").option("pattern", pattern).option("recursive", str(recursive)).option("method", method).load(path)


def write_raw_matrices(rows: DataFrame, folder: str, key: str = "utt_id", pos: str = "frame", values: str = "values",
                       dtype: str = "f4", endian: str = "little", suffix: str = ".ppg") -> DataFrame:
    """One ``{key}{suffix}`` file of frames in order per recording, streamed; returns key, path, n_frames.

    A file is written under its own name only when it is whole, so a repeated task replaces it.
    """
    kind = {"little": "<", "big": ">", "native": "="}[endian] + dtype

    def run(batches):
        import pandas as pd

        name = file = store = None
        n = 0

        def finish():
            file.close()
            store.move(at + ".part", at)
            return pd.DataFrame({"key": [name], "path": [f"{folder}/{name}{suffix}"], "n_frames": [n]})

        for batch in batches:
            for own, part in batch.groupby("key", sort=False):
                if own != name:
                    if file is not None:
                        yield finish()
                    name, n = own, 0
                    store, at = open_store(f"{folder}/{own}{suffix}")
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(at + ".part")
                file.write(np.stack(part["values"].to_numpy()).astype(kind).tobytes())
                n += len(part)
        if file is not None:
            yield finish()

    named = rows.select(F.col(key).cast("string").alias("key"), pos, F.col(values).alias("values"))
    made = named.repartition("key").sortWithinPartitions("key", pos).drop(pos).mapInPandas(run, "key string, path string, n_frames bigint")
    return made.withColumnRenamed("key", key)
