"""Shares of the pool: walks that leave the range for long, and sums taken from the inverse draw."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewright.operators import pool as P


def plain(j, size, a, b, c, d):
    bits = max(size - 1, 1).bit_length()
    mask, half, steps = (1 << bits) - 1, (bits + 1) // 2, 0
    x = j
    while True:
        for factor, plus in ((a, b), (c, d)):
            x = (x * (factor * 2 + 1) + plus) & mask
            x ^= x >> half
        steps += 1
        if x < size:
            return x, steps


def test_long_walks_come_back():
    """Numbers whose walk leaves 0..size-1 for more than 64 rounds: every index is still met once."""
    size, numbers = 1025, (0, 1, 0, 1)
    walks = [plain(j, size, *numbers) for j in range(size)]
    assert max(steps for _, steps in walks) > 65
    cols = [pd.Series([v] * size, dtype="int64") for v in (size, *numbers)]
    got = P._permuted(pd.Series(range(size), dtype="int64"), *cols)
    assert got.tolist() == [x for x, _ in walks] and sorted(got) == list(range(size))


@pytest.mark.parametrize("share", [0.5, 0.07, 0.0001])
def test_sums_of_shares_are_those_of_the_drawn_rows(spark, share, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 16)
    monkeypatch.setattr(P, "BUNDLE", 8)
    pool = spark.range(150).select(
        (F.col("id") * 3).alias("speaker_id"), (F.col("id") * 7 % 150).alias("ord"), F.when(F.col("id") % 3 == 0, "f").otherwise("m").alias("gender"),
        F.array((F.col("id") / 7), F.lit(1.0)).alias("xvector"))
    pitch = pool.select("speaker_id", (F.col("speaker_id") / 99).alias("m"), F.lit(0.1).alias("s"), (F.col("speaker_id") % 5 + 1).alias("w"))
    asked = spark.range(40).select(F.col("id").alias("seed"), F.lit("any").alias("gender"))
    out = {r["seed"]: r for r in P.generate_pseudospeakers(asked, pool, pitch, share).collect()}
    known = pool.join(pitch, "speaker_id")
    drawn = P.sample_speakers(asked.withColumn("gender", P.draw_gender(F.col("seed"))), known, share).drop("gender").join(known, "speaker_id")
    want = drawn.groupBy("seed").agg(
        F.array_sort(F.collect_list("speaker_id")).alias("selected"), F.avg(F.col("xvector")[0]).alias("x"), P._majority().alias("gender"), *P._pooled()).collect()
    assert len(out) == len(want) == 40
    for r in want:
        mine = out[r["seed"]]
        assert mine["selected"] == r["selected"] and mine["gender"] == r["gender"] and mine["xvector"] == pytest.approx([r["x"], 1.0])
        assert (mine["mean"], mine["std"]) == pytest.approx((r["mean"], r["std"]))


def test_draws_of_a_share_are_looked_up_where_they_are_made(spark, monkeypatch):
    """They were shuffled to meet the ids, all from the one task that the few requests fit into."""
    monkeypatch.setattr(P, "_PIECE", 16)
    pool = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id").cast("string")).alias("speaker_id"), (F.col("id") * 7 % 300).alias("ord"), (F.col("id") % 3).alias("cluster"))
    asked = spark.range(50).coalesce(1).select(F.col("id").alias("seed"), (F.col("id") % 4).alias("cluster"), F.lit(None).cast("string").alias("note"))
    out = P.sample_speakers(asked, pool, 0.3, "cluster")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "RoundRobinPartitioning" in plan
    got = sorted((r["seed"], r["cluster"], r["note"], r["speaker_id"]) for r in out.collect())
    monkeypatch.setattr(P, "_SMALL", 0)  # ids beyond the limit meet the draws in a join
    other = P.sample_speakers(asked, pool, 0.3, "cluster")
    assert got == sorted((r["seed"], r["cluster"], r["note"], r["speaker_id"]) for r in other.collect())
    assert len(set(got)) == len(got) == sum(30 for seed in range(50) if seed % 4 < 3)


@pytest.mark.parametrize("criterion", [None, P.SPARSE])
def test_ids_of_a_share_stay_where_they_are_drawn(spark, criterion, monkeypatch):
    """Rows of sums and ids per request and chunk were shuffled to be put together; equal requests still count twice."""
    monkeypatch.setattr(P, "CHUNK", 16)
    pool = spark.range(200).select(
        F.format_string("s%d", "id").alias("speaker_id"), (F.col("id") * 7 % 200).alias("ord"), F.when(F.col("id") % 3 == 0, "f").otherwise("m").alias("gender"),
        (F.col("id") % 5).alias("cluster"), F.array(F.col("id") / 7, F.lit(1.0)).alias("xvector"))
    pitch = pool.select("speaker_id", (F.col("ord") / 99).alias("m"), F.lit(0.1).alias("s"), (F.col("ord") % 5 + 1).alias("w"))
    clusters = spark.range(5).select(F.col("id").alias("cluster"), F.col("id").alias("density_pos"), F.when(F.col("id") < 2, "f").otherwise("m").alias("gender"))
    asked = spark.range(40).select((F.col("id") % 30).alias("seed"), F.lit("any").alias("gender"), F.lit("x").alias("note"))

    def run():
        return P.generate_pseudospeakers(asked, pool, pitch, 0.4, criterion, clusters, 2)

    out = run()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[:plan.index("MapInArrow")]
    got = {r["seed"]: r for r in out.collect()}
    monkeypatch.setattr(P, "POOL_LIMIT", 0)  # a pool beyond the limit is shuffled in chunks
    other = {r["seed"]: r for r in run().collect()}
    assert set(got) == set(other) == set(range(30))
    assert len(got[3]["selected"]) == 2 * len(set(got[3]["selected"])) and len(got[13]["selected"]) == len(set(got[13]["selected"]))
    for seed, r in got.items():
        o = other[seed]
        assert (r["asked_gender"], r["gender"], r["note"], r["selected"]) == (o["asked_gender"], o["gender"], o["note"], o["selected"])
        assert [*r["xvector"], r["mean"], r["std"]] == pytest.approx([*o["xvector"], o["mean"], o["std"]])
