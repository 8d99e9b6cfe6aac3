"""Incremental runs over arriving files, and their progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from framewright.session import remove_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a piece that leaves the state at once.
PIECE_ROWS = 10_000


class WholeRecordings(StatefulProcessor):
    """Keeps the rows of a recording until as many distinct positions as its manifest says are there.

    Per recording the state holds the pieces as they arrived (Arrow bytes), a bitmap
    of the positions, and once it has been emitted only a mark, which late rows meet. A batch
    reads the bitmaps of the recordings it brings rows of, and the pieces of those
    it completes; nothing else.
    """

    def __init__(self, schema: T.StructType, pos: str):
        self.schema, self.pos = schema, pos

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "rows binary")
        self.seen = handle.getValueState("seen", "bits binary, n bigint")
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pyarrow as pa

        arrow, wanted, fresh = to_arrow_schema(self.schema), None, []
        if self.done.exists():
            for _ in rows:
                pass
            return
        bits, n = self.seen.get() if self.seen.exists() else (b"", 0)
        bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in rows:
            known = batch["n_rows"].dropna()
            wanted = int(known.iloc[0]) if len(known) else wanted
            at = batch[self.pos].to_numpy(dtype=np.int64)
            if len(at) and int(at.max()) >= len(bits):
                bits = np.append(bits, np.zeros(2 * int(at.max()) + 8 - len(bits), bool))
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            new = first & ~bits[at]
            bits[at] = True
            n += int(new.sum())
            if new.any():
                table = pa.Table.from_pandas(batch.loc[new, arrow.names], schema=arrow, preserve_index=False)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, arrow) as writer:
                    writer.write_table(table)
                fresh.append((sink.getvalue().to_pybytes(),))
        if wanted is None or n < wanted:
            if fresh:
                self.pieces.appendList(fresh)
                self.seen.update((np.packbits(bits).tobytes(), n))
            return
        for held in (self.pieces.get(), fresh):
            for (piece,) in held:
                whole = pa.ipc.open_stream(piece).read_all()
                for first in range(0, whole.num_rows, PIECE_ROWS):
                    yield whole.slice(first, PIECE_ROWS).to_pandas()
        self.pieces.clear()
        self.seen.clear()
        self.done.update((True,))

    def close(self) -> None:
        pass


def whole_recordings(rows: DataFrame, expected: DataFrame, key: str = "utt_id", pos: str = "frame") -> DataFrame:
    """A stream of the rows of recordings that are complete, from a stream of rows in any order.

    ``expected`` (key, ``n_rows``) is the manifest. A row delivered again is ignored,
    also after its recording has left. A recording outside the manifest waits; rows
    without key or position are left out.
    """
    schema = rows.schema
    counted = rows.filter(F.col(pos).isNotNull() & F.col(key).isNotNull()).join(expected.select(key, F.col("n_rows").cast("bigint").alias("n_rows")), key, "left")
    return counted.groupBy(key).transformWithStateInPandas(WholeRecordings(schema, pos), schema, "Append", "None")


def stream_anonymize(
    spark: SparkSession, in_dir: str, schema: str, out: str, checkpoint: str,
    process: Callable[[DataFrame], DataFrame], expected: DataFrame, key: str = "utt_id", pos: str = "frame",
    files_per_batch: int = 100, available_now: bool = True,
) -> StreamingQuery:
    """Run ``process`` on every recording once, as soon as all of its rows have arrived.

    ``expected`` (key, ``n_rows``) is the manifest: a recording is complete with
    that many distinct positions (integers from 0), however its rows are spread over files and
    micro-batches. Rows that wait are keyed state (``WholeRecordings``) in the
    checkpoint and leave it with their recording, so a batch costs what it brings,
    not what came before. Complete recordings are written once per batch, processed
    from there and deleted; results are under ``{out}/results``. Each batch replaces its
    own ``batch_id`` partitions, so a batch that is repeated after a failure leaves
    one copy.
    """

    def keep(rows: DataFrame, name: str, batch_id: int) -> None:
        (rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{out}/{name}"))

    def run(batch: DataFrame, batch_id: int) -> None:
        # The only action on the batch itself: the state is read and written once.
        path = f"{out}/complete/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        keep(process(spark.read.schema(batch.schema).parquet(path)), "results", batch_id)
        remove_table(spark, path)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(in_dir)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:  # a query keeps the settings it starts with
        whole = whole_recordings(source, expected, key, pos)
        writer = whole.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(PROVIDER, before)


def stream_progress(results: DataFrame, total: int, seconds: str = "seconds") -> DataFrame:
    """Running count, mean seconds and estimated rest of a stream of finished recordings."""
    return results.groupBy().agg(
        F.count(F.lit(1)).alias("completed"), F.avg(seconds).alias("mean_seconds")).select(
        "completed", "mean_seconds", (100.0 * F.col("completed") / total).alias("percent"),
        ((total - F.col("completed")) * F.col("mean_seconds")).alias("eta_seconds"))
