import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import evaluate as V
from framewright.operators import hooks as H


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_error_rate(spark):
    rnd = random.Random(5)
    texts = [(" ".join(rnd.choices("abcd", k=rnd.randint(0, 90))), " ".join(rnd.choices("abcde", k=rnd.randint(0, 90)))) for _ in range(60)]
    texts += [("", ""), ("", "a b"), ("a", "")]
    df = spark.createDataFrame([(i, r, h) for i, (r, h) in enumerate(texts)], "i int, ref string, hyp string")
    for r in V.wer_pairs(df).collect():
        ref, hyp = (t.split() for t in texts[r["i"]])
        assert r["edits"] == distance(ref, hyp) and r["wer"] == pytest.approx(r["edits"] / max(1, len(ref)))


@pytest.mark.parametrize("bins", [2, 256])
def test_percentiles_of_extreme_values(spark, bins):
    """Ties, nulls, null keys, signs, zeros, infinities and values over all powers of two."""
    rng = np.random.default_rng(3)
    groups = {
        1: list(2.0 ** rng.integers(-1000, 1000, 301)), 2: [5.0] * 40, 3: [-0.0, 0.0, 1e-310, -1e-310], 4: [float("-inf"), -1.0, 2.0, 3.0, float("inf")],
        5: list(rng.normal(0, 1, 500)) + [1e300], 6: [7.5], None: list(-rng.random(77)), 8: [1.0 + n * 2.0**-52 for n in range(33)],
    }
    rows = [(g, float(x)) for g, values in groups.items() for x in values] + [(5, None), (9, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(3)
    got = {r["g"]: r for r in V.exact_percentiles(df, ["g"], "x", {"low": 0.0, "p50": 0.5, "p95": 0.95}, bins).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        x = sorted(values)
        for name, share in (("low", 0.0), ("p50", 0.5), ("p95", 0.95)):
            at = (len(x) - 1) * share
            a, b = x[int(at)], x[int(np.ceil(at))]
            assert got[g][name] == (a if a == b else a + (b - a) * (at - int(at))) or g == 4


def test_percentiles_of_a_hot_group(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": np.where(np.arange(500) < 450, "hot", "cold"), "x": rng.integers(0, 60, 500) / 7, "id": range(500)})
    out = V.exact_percentiles(spark.createDataFrame(pdf).repartition(6), ["g"], "x", {"p50": 0.5, "p95": 0.95, "p100": 1.0})
    for r in out.collect():
        x = pdf[pdf.g == r["g"]].x
        np.testing.assert_allclose([r["p50"], r["p95"], r["p100"]], np.percentile(x, [50, 95, 100]))


def test_timing_fallback_and_factor(spark):
    rows = [("a", "s", 4.0, 2.0, 1, True, 0), ("a", "s", 1.0, 2.0, 2, False, 1), ("a", "s", 3.0, None, 3, False, 2), ("b", "s", 5.0, 10.0, 1, True, 3)]
    df = spark.createDataFrame(rows, "grp string, stage string, seconds double, audio_seconds double, file int, cold boolean, row_id int")
    out = {r["grp"]: r for r in V.timing_table(df).collect()}
    assert (out["a"]["cold"], out["a"]["warm_mean"], out["a"]["warm_rtf"], out["a"]["n"]) == (4.0, 2.0, None, 3)
    assert (out["b"]["cold"], out["b"]["warm_median"], out["b"]["warm_rtf"]) == (5.0, 5.0, 0.5)


def test_first_k_uses_a_rank_limit(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("g"), (F.col("id") % 10).alias("s"), "id")
    out = V.first_k_per_group(df, "g", "s", "id", 2)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_same_output(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert V.same_output(a, a.repartition(2)).first()["same"]
    r = V.same_output(a, a.distinct()).first()
    assert (r["only_a"], r["only_b"], r["same"]) == (1, 0, False)


def test_groups_and_folds_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 11 % 3).alias("k"), F.col("id").alias("pos"), (F.col("id") * 3 % 17).alias("v"))
        want = {r["k"]: (r["n"], r["s"]) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("pos")).alias("s")).collect()}

        def one(pdf):
            assert pdf["pos"].is_monotonic_increasing
            return pd.DataFrame({"k": [pdf["k"].iloc[0]], "n": [len(pdf)], "s": [(pdf["v"] * pdf["pos"]).sum()]})

        got = H.map_groups(df, ["k"], ["pos"], one, "k bigint, n bigint, s bigint").collect()
        assert {r["k"]: (r["n"], r["s"]) for r in got} == want

        def step(state, rows):
            k, n, s = state or (rows["k"].iloc[0], 0, 0)
            return (k, n + len(rows), s + int((rows["v"] * rows["pos"]).sum())), None

        got = H.fold_frames(df, step, lambda s: pd.DataFrame([s], columns=["k", "n", "s"]), "k bigint, n bigint, s bigint", "k", "pos").collect()
        assert {r["k"]: (r["n"], r["s"]) for r in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_failing_rows_become_messages(spark):
    df = spark.range(4)
    out = {r["id"]: (r["value"], r["error"]) for r in H.try_rows(df, lambda n: 6 // n, "bigint", F.col("id")).collect()}
    assert out[0][0] is None and out[0][1].startswith("ZeroDivisionError") and out[3] == (2, None)
