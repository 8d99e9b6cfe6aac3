"""Block-wise scans against plain windows, with blocks far smaller than the keys."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.operators import scans as N


@pytest.fixture(scope="module")
def rows(spark):
    # Key 0 holds two thirds of all rows.
    return spark.range(900).select(
        F.when(F.col("id") < 600, 0).otherwise(1 + F.col("id") % 3).alias("k"),
        F.when(F.col("id") < 600, F.col("id")).otherwise(((F.col("id") - 600) / 3).cast("bigint")).alias("frame"),
        ((F.col("id") * 7919) % 101 - 50).alias("v"), "id").repartition(5)


def whole():
    return W.partitionBy("k").orderBy("frame").rowsBetween(W.unboundedPreceding, 0)


def diff(got, rows, expr, name="out"):
    want = rows.withColumn("_want", expr).select("id", "_want")
    return got.count(), got.join(want, "id").filter(~F.col(name).eqNullSafe(F.col("_want"))).count()


def test_running_sum(rows):
    got = N.running_sum(rows, "k", F.col("v"), "out", block=16)
    assert diff(got, rows, F.sum("v").over(whole())) == (900, 0)
    got = N.running_sum(rows, "k", F.col("v"), "out", block=16, inclusive=False)
    assert diff(got, rows, F.sum("v").over(whole()) - F.col("v")) == (900, 0)


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_last(rows, inclusive):
    value = F.when(F.col("v") % 37 == 0, F.col("v"))
    w = whole() if inclusive else W.partitionBy("k").orderBy("frame").rowsBetween(W.unboundedPreceding, -1)
    got = N.running_last(rows, "k", value, "out", block=16, inclusive=inclusive)
    assert diff(got, rows, F.last(value, ignorenulls=True).over(w)) == (900, 0)


def test_running_max(rows):
    got = N.running_max(rows, "k", {"out": F.col("v")}, pos="frame", block=16)
    assert diff(got, rows, F.max("v").over(whole())) == (900, 0)


def test_neighbours_and_lag(rows):
    w = W.partitionBy("k").orderBy("frame")
    got = N.with_neighbours(rows, "k", {"out": lambda w: F.sum("v").over(w.rowsBetween(-5, 3))}, 5, 3, block=4)
    assert diff(got, rows, F.sum("v").over(w.rowsBetween(-5, 3))) == (900, 0)
    got = N.with_lag_lead(rows, "k", lag={"out": "v"}, lead={"nxt": "v"}, block=4)
    assert diff(got, rows, F.lag("v").over(w)) == (900, 0)
    assert diff(got, rows, F.lead("v").over(w), "nxt") == (900, 0)


def test_totals_and_attach(rows):
    got = N.with_totals(rows, "k", [F.sum("v").alias("out")], block=16)
    assert diff(got, rows, F.sum("v").over(W.partitionBy("k"))) == (900, 0)
    table = rows.groupBy("k").agg(F.max("v").alias("out"))
    assert diff(N.attach(rows, table, "k", block=16), rows, F.max("v").over(W.partitionBy("k"))) == (900, 0)


def test_scan_gives_all_in_two_reads(rows):
    value = F.when(F.col("v") % 37 == 0, F.col("v"))
    got = N.scan(rows, "k", sums={"out": F.col("v")}, lasts={"seen": value}, maxima={"top": F.col("v")},
                 totals={"n": ("sum", F.lit(1)), "low": ("min", F.col("v"))}, block=16)
    assert diff(got, rows, F.sum("v").over(whole())) == (900, 0)
    assert diff(got, rows, F.last(value, ignorenulls=True).over(whole()), "seen") == (900, 0)
    assert diff(got, rows, F.max("v").over(whole()), "top") == (900, 0)
    assert diff(got, rows, F.count("v").over(W.partitionBy("k")), "n") == (900, 0)
    assert diff(got, rows, F.min("v").over(W.partitionBy("k")), "low") == (900, 0)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (1, 0, 5)], "k bigint, frame bigint, v bigint")
    got = N.with_totals(N.running_sum(df, "k", F.col("v"), "s"), "k", [F.max("v").alias("m")])
    assert sorted((tuple(r) for r in got.select("k", "frame", "s", "m").collect()), key=repr) == sorted(
        [(None, 0, 1, 2), (None, 1, 3, 2), (1, 0, 5, 5)], key=repr)
    table = spark.createDataFrame([(None, "x"), (1, "y")], "k bigint, t string")
    assert N.attach(df, table, "k").filter("k is null and t = 'x'").count() == 2


def test_hot_key_is_spread(rows):
    """No window or join partition may hold the whole hot key."""
    got = N.running_sum(rows, "k", F.lit(1), "out", block=50)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and any("_blk" in line for line in windows)
    sizes = rows.withColumn("b", F.expr("frame div 50")).groupBy("k", "b").count().agg(F.max("count")).first()[0]
    assert sizes <= 50


def test_number_rows(rows):
    got = N.number_rows(rows, ["v", "id"], ["k"], out="out")
    assert diff(got, rows, F.row_number().over(W.partitionBy("k").orderBy("v", "id")) - 1) == (900, 0)
    got = N.number_rows(rows, [-F.col("v"), F.col("id")], out="out")
    assert diff(got, rows, F.row_number().over(W.orderBy(F.desc("v"), "id")) - 1) == (900, 0)


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_number_rows_in_many_ranges(rows, parts):
    got = N.number_rows(rows, ["v", "id"], ["k"], out="out", parts=parts)
    assert diff(got, rows, F.row_number().over(W.partitionBy("k").orderBy("v", "id")) - 1) == (900, 0)
    got = N.number_rows(rows, ["id"], out="out", parts=parts)
    assert diff(got, rows, F.row_number().over(W.orderBy("id")) - 1) == (900, 0)
    assert N.number_rows(rows.limit(0), ["id"], parts=parts).count() == 0


def test_number_rows_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 5), (1, None)], "k bigint, v bigint")
    got = sorted(((r["k"], r["v"], r["row_no"]) for r in N.number_rows(df, ["v"], ["k"]).collect()), key=repr)
    assert got == sorted([(None, 1, 0), (None, 2, 1), (1, None, 0), (1, 5, 1)], key=repr)


def test_number_rows_shuffles_no_rows_after_the_ranges(rows):
    """What is left to do after the written ranges joins small tables; no window and no sort of rows."""
    for keys in ((), ("k",)):
        got = N.number_rows(rows, ["v", "id"], keys, out="out")
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "RangePartitioning" not in plan and "rangepartitioning" not in plan
        assert all("_range" in line for line in plan.splitlines() if "Window [" in line)


def test_number_rows_spreads_a_hot_key(spark):
    """One key with nearly all rows fills many ranges."""
    df = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    got = N.number_rows(df, ["v"], ["k"], parts=16)
    sizes = [r["n"] for r in got.groupBy("k").agg(F.count("k").alias("n"), F.max("row_no").alias("m")).filter("n <> m + 1").collect()]
    assert not sizes
    assert diff(got.withColumnRenamed("row_no", "out"), df, F.row_number().over(W.partitionBy("k").orderBy("v")) - 1) == (20_000, 0)


def test_broadcast_only_below_the_limit(spark):
    table = spark.range(100)
    assert N.bounded_broadcast(table, F.lit(8), 10_000) is not table
    assert N.bounded_broadcast(table, F.lit(8), 100) is table
