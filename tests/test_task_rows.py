"""What one task holds must not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import editing as E
from framewright.operators import segments as G
from framewright.operators.scans import number_rows
from framewright.session import materialize

SHUFFLES, ADVISORY = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def settings(spark):
    before = {name: spark.conf.get(name) for name in (SHUFFLES, ADVISORY)}
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def test_ranges_and_shuffles_grow_with_the_rows(spark, settings):
    rows = spark.range(5000).select((F.col("id") % 7).alias("utt_id"), (F.col("id") * 37 % 5000).alias("at"))
    assert int(spark.conf.get(SHUFFLES)) < 50
    got = number_rows(rows, "at", ["utt_id"], out="n", task_rows=100)
    assert int(spark.conf.get(SHUFFLES)) == 50
    want = {}
    for utt, at in sorted((r["utt_id"], r["at"]) for r in rows.collect()):
        want[utt, at] = sum(1 for u, _ in want if u == utt)
    assert {(r["utt_id"], r["at"]): r["n"] for r in got.collect()} == want
    number_rows(rows.limit(10), "at", out="n", task_rows=100)
    assert int(spark.conf.get(SHUFFLES)) == 50


def test_generated_rows_are_dealt_out(spark):
    """All of them stood in the one partition that the few recordings they grew from fit into."""
    utts = spark.range(2000).select((F.col("id") % 1000).alias("utt_id")).distinct()
    where = utts.select("utt_id", F.lit(0).cast("bigint").alias("seg"), F.lit(0).cast("bigint").alias("f0"), F.lit(600).cast("bigint").alias("f1"))
    generated = where.select("utt_id", "seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(599).cast("bigint"))).alias("i")).withColumn("code", F.col("i") + 1)
    base = utts.select("utt_id", F.lit(3).cast("bigint").alias("frame"), F.lit(0).cast("bigint").alias("code"))
    out = G.overlay_segments(base, generated, where, "code")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION" in plan[:plan.index("Generate explode")]
    assert {r["code"] for r in out.collect()} == {4}


def test_pieces_are_converted_once(spark):
    """Their sizes and their frames each ran the conversion again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(frame):
        seen.add(1)
        return frame

    def frames(n, *more):
        return spark.range(n).select(F.lit(1).cast("bigint").alias("utt_id"), *more, F.col("id").alias("frame"), F.lit(1.0).alias("f0"), F.array(F.lit(1.0)).alias("vec"))

    ops = spark.createDataFrame([(1, 0, 20, 24)], "utt_id bigint, op bigint, start_frame bigint, end_frame bigint")
    out = E.apply_splices(frames(60), ops, frames(30, F.lit(0).cast("bigint").alias("op")), 4, lambda df: df.withColumn("frame", counted("frame")))
    assert sorted(r["frame"] for r in out.select("frame").collect()) == list(range(60 - 4 + 30 - 8))
    assert seen.value == 30


def test_narrow_tables_do_not_gather_in_the_driver(spark):
    """A table of packed keys and numbers was joined by broadcast, for which the driver holds it as a hash table of many times its file."""
    numbers = F.pmod(F.xxhash64("id"), F.lit(500)).alias("first")
    table = materialize(spark.range(250_000).select(F.expr("id div 60").alias("utt_id"), numbers, (F.col("id") % 3).alias("op")), "packed")
    large = materialize(spark.range(2_000_000).select(F.col("id").alias("utt_id"), numbers), "large")
    plan = large.join(table, ["utt_id", "first"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    few = materialize(spark.range(100).select(F.col("id").alias("utt_id")), "few")
    assert "BroadcastHashJoin" in large.join(few, "utt_id")._jdf.queryExecution().executedPlan().toString()
