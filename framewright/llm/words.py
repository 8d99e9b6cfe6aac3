"""Whole texts as byte arrays: slices of Arrow batches, word bounds and 64-bit hashes, all vectorised.

Nothing here keeps large module-level state, because functions travel to the
workers by value; tables are built once per task by the classes below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch: whole texts are large rows, and each of an
#: executor's workers and the JVM hold a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_class(spec: str) -> np.ndarray:
    """The bytes that belong to words: "alnum" ([0-9A-Za-z\\x80-\\xff]) or "solid" (no ASCII white space)."""
    b = np.arange(256)
    if spec == "solid":
        return ~((b == 32) | ((b >= 9) & (b <= 13)))
    if spec == "alnum":
        return ((b >= 48) & (b <= 57)) | ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122)) | (b >= 128)
    raise ValueError(spec)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows whose texts fill about ``limit`` bytes (one row at least)."""
    data, offsets = text_bytes(batch.column(text))
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        part = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
        first = last


class Words:
    """Finds the words of a slice. Hashes ignore the case of A-Z if ``lower``."""

    def __init__(self, spec: str, lower: bool = True):
        self.word = byte_class(spec)
        letter = np.arange(256, dtype=np.uint64)
        if lower:
            letter[65:91] += np.uint64(32)
        self.code = mix64(letter + np.uint64(0x1F3)) | np.uint64(1)
        self.base, self.power, self.inverse = 0x5851F42D4C957F2D, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            size = max(n, SLICE_BYTES + 1)
            for name, value in (("power", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
                factors = np.full(size, value, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number, start, end) of each word, in order."""
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = self.word[data]
        starts, ends = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        edge = offsets[1:-1]
        cut = edge[inside[edge] & inside[edge + 1]]  # words of two texts that touch
        starts[cut] = True
        start = np.flatnonzero(starts)
        if len(cut):
            ends[cut] = True
        end = np.flatnonzero(ends)
        return np.searchsorted(offsets, start, "right") - 1, start, end

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[: len(data)], out=total[1:])
        return mix64((total[end] - total[start]) * self.inverse[start])

    def scan(self, data: np.ndarray, offsets: np.ndarray):
        doc, start, end = self.bounds(data, offsets)
        return doc, start, end, self.hashes(data, start, end)


def windows(values: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index, hash) of every run of ``k`` neighbouring values of one document."""
    if len(values) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    first = np.flatnonzero(doc[k - 1 :] == doc[: len(doc) - k + 1])
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        total = mix64(total * np.uint64(0x2545F4914F6CDD1D) + values[first + j])
    return first, total


def tidy(run: Callable) -> Callable:
    """The same ``mapInArrow`` function, which gives Arrow's unused memory back after each batch.

    A worker process outlives its task; without this it keeps the memory of its
    largest batch while the next stage's workers already run.
    """

    def tidied(batches):
        for made in run(batches):
            yield made
            pa.default_memory_pool().release_unused()
        pa.default_memory_pool().release_unused()

    return tidied


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless its owner has set a bound."""
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def add_columns(docs: DataFrame, make: Callable[[], Callable], fields: str, text: str = "text", keep: list[str] | None = None,
                limit: int = SLICE_BYTES) -> DataFrame:
    """The kept columns of ``docs`` (all by default) and the new ``fields``, worked out slice by slice.

    ``make()`` runs once per task and gives ``fn(rows, data, offsets) -> {field: values}``.
    A new field replaces an old column of the same name. A null text counts as empty.
    """
    small_batches(docs.sparkSession)
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]
    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(names)], docs[text].cast("string").alias("body"))
    schema = T.StructType([T.StructField(n, docs.schema[n].dataType) for n in names] + list(new))
    want = to_arrow_schema(new)

    def run(batches):
        fn = make()
        for batch in batches:
            for rows, data, offsets in sliced(batch, "body", limit):
                made = fn(rows, data, offsets)
                arrays = [rows.column(i) for i in range(len(names))]
                for field in want:
                    value = made[field.name]
                    arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type))
                yield pa.RecordBatch.from_arrays(arrays, [*names, *want.names])

    return source.mapInArrow(tidy(run), schema)
