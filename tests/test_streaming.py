from pyspark.sql import functions as F

from framewright.streaming import incremental as ST

SCHEMA = "utt_id bigint, frame bigint, f0 double"


def rows(spark, utts):
    return spark.createDataFrame([(u, i, float(u + i)) for u in utts for i in range(3)], SCHEMA)


def run(spark, path, process=lambda df: df.withColumn("f0", F.col("f0") * 2), mark="marks", n_rows=3, files=100):
    expected = spark.createDataFrame([(u, n_rows) for u in range(10)], "utt_id bigint, n_rows bigint")
    ST.stream_anonymize(spark, f"{path}/in", SCHEMA, f"{path}/out", f"{path}/{mark}", process, expected,
                        files_per_batch=files).awaitTermination()
    return spark.read.schema(SCHEMA + ", batch_id bigint").parquet(f"{path}/out/results")


def test_a_recording_over_two_batches_is_whole(spark, tmp_path):
    whole = spark.createDataFrame([(1, i, float(i)) for i in range(10)], SCHEMA)
    for part in ("frame < 4", "frame >= 4"):
        whole.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    seen = []

    def process(df):
        seen.append(df.count())
        return df

    out = run(spark, tmp_path, process, n_rows=10, files=1)
    assert sorted(r["frame"] for r in out.collect()) == list(range(10)) and seen == [0, 10]


def test_an_incomplete_recording_waits(spark, tmp_path):
    rows(spark, [1]).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path, n_rows=4).count() == 0
    spark.createDataFrame([(1, 3, 4.0), (1, 2, 3.0)], SCHEMA).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r["frame"] for r in run(spark, tmp_path, n_rows=4).collect()) == [0, 1, 2, 3]


def test_each_key_once_over_restarts(spark, tmp_path):
    rows(spark, [1, 2]).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path).count() == 6
    rows(spark, [2, 3]).write.mode("append").parquet(f"{tmp_path}/in")
    out = run(spark, tmp_path)
    assert out.count() == 9 and out.select("utt_id").distinct().count() == 3


def test_a_failed_batch_is_repeated(spark, tmp_path):
    rows(spark, [1, 2]).write.parquet(f"{tmp_path}/in")

    def broken(df):
        raise RuntimeError("lost")

    try:
        run(spark, tmp_path, broken)
    except Exception:  # noqa: BLE001
        pass
    out = run(spark, tmp_path)
    assert sorted((r["utt_id"], r["f0"]) for r in out.collect()) == sorted(
        (u, 2.0 * (u + i)) for u in (1, 2) for i in range(3))


def test_repeating_a_whole_stream_keeps_one_copy(spark, tmp_path):
    rows(spark, [1, 2]).write.parquet(f"{tmp_path}/in")
    run(spark, tmp_path)
    # New checkpoint, same batch number: the partition is replaced, not doubled.
    assert run(spark, tmp_path, mark="other").count() == 6


def test_state_does_not_grow_with_the_history(spark, tmp_path):
    """50 micro-batches, each ends a recording and begins the next: what a batch reads and keeps stays the same."""
    for n in range(50):
        part = [(n, i, float(i)) for i in range(40, 60)] + [(n + 1, i, float(i)) for i in range(40)]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    expected = spark.createDataFrame([(u, 60 if u else 20) for u in range(51)], "utt_id bigint, n_rows bigint")
    sizes = []

    def process(rows):
        sizes.append(rows.count())
        return rows

    query = ST.stream_anonymize(spark, f"{tmp_path}/in", SCHEMA, f"{tmp_path}/out", f"{tmp_path}/marks", process, expected, files_per_batch=1)
    query.awaitTermination()
    assert len(sizes) == 50 and sorted(sizes) == [20] + [60] * 49
    held = [(p["batchId"], p["stateOperators"][0]) for p in query.recentProgress if p["stateOperators"]]
    # The state has one mark per finished recording, and pieces and bitmap of the one that waits.
    assert all(state["numRowsTotal"] <= n + 1 + 4 for n, state in held)
    assert max(state["numRowsUpdated"] for _, state in held) <= 6
    out = spark.read.schema(SCHEMA + ", batch_id bigint").parquet(f"{tmp_path}/out/results")
    assert out.count() == 20 + 49 * 60
    assert not list((tmp_path / "out" / "complete").glob("batch_id=*"))


def test_late_rows_of_finished_recordings_are_ignored(spark, tmp_path):
    rows(spark, [1, 2]).write.parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path).count() == 6
    late = rows(spark, [1, 2]).union(spark.createDataFrame([(2, 7, 1.0), (None, 1, 1.0), (3, None, 1.0), (9, 0, 0.0), (9, 0, 5.0)], SCHEMA))
    late.write.mode("append").parquet(f"{tmp_path}/in")
    assert run(spark, tmp_path).count() == 6
    spark.createDataFrame([(9, 2, 2.0), (9, 1, 1.0), (9, 0, 7.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path).filter("utt_id = 9").collect()
    assert len(got) == 3 and {r["f0"] for r in got if r["frame"] == 0} <= {0.0, 10.0}


def test_arrays_and_a_recording_outside_the_manifest(spark, tmp_path):
    schema = "utt_id bigint, frame bigint, vec array<double>, note string"
    data = [(u, i, [float(i), None], None if i else "n") for u in (1, 42) for i in range(3)] + [(2, 0, None, None), (2, 1, [], ""), (2, 2, [1.0], "x")]
    for n in range(3):
        spark.createDataFrame(data[n::3], schema).write.mode("append").parquet(f"{tmp_path}/in")
    expected = spark.createDataFrame([(u, 3) for u in range(10)], "utt_id bigint, n_rows bigint")
    ST.stream_anonymize(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out", f"{tmp_path}/marks", lambda d: d, expected, files_per_batch=1).awaitTermination()
    got = spark.read.schema(schema + ", batch_id bigint").parquet(f"{tmp_path}/out/results").drop("batch_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((x for x in data if x[0] != 42), key=repr)


def test_progress(spark, tmp_path):
    spark.range(4).select(F.col("id").alias("file"), (F.col("id") * 1.0).alias("seconds")).write.parquet(f"{tmp_path}/done")
    stream = spark.readStream.schema("file bigint, seconds double").parquet(f"{tmp_path}/done")
    q = ST.stream_progress(stream, 10).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(
        availableNow=True).start()
    q.awaitTermination()
    r = spark.table("seen").first()
    assert (r["completed"], r["mean_seconds"], r["percent"], r["eta_seconds"]) == (4, 1.5, 40.0, 9.0)
