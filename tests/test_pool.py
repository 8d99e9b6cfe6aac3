import pytest
from pyspark.sql import functions as F

from framewright.operators import pool as P


@pytest.fixture(scope="module")
def pool(spark):
    return spark.range(60).select(
        F.col("id").alias("speaker_id"), F.col("id").alias("ord"), F.when(F.col("id") % 3 == 0, "f").otherwise("m").alias("gender"),
        (F.col("id") % 4).alias("cluster"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("xvector"))


@pytest.fixture(scope="module")
def requests(spark):
    return spark.range(300).select(F.col("id").alias("seed"), F.when(F.col("id") % 2 == 0, "f").otherwise("m").alias("gender"))


@pytest.mark.parametrize("n,want_f,want_m", [(3, 3, 3), (30, 20, 30), (0.5, 10, 20), (0.001, 1, 1)])
def test_sample_sizes(pool, requests, n, want_f, want_m):
    out = P.sample_speakers(requests, pool, n).join(pool.select("speaker_id", F.col("gender").alias("g")), "speaker_id")
    assert out.filter("g <> gender").count() == 0
    sizes = out.groupBy("seed", "gender").agg(F.countDistinct("speaker_id").alias("d"), F.count("*").alias("n")).collect()
    assert len(sizes) == 300
    for r in sizes:
        assert r["d"] == r["n"] == (want_f if r["gender"] == "f" else want_m)


def test_draws_are_even_and_repeatable(pool, requests):
    one = P.sample_speakers(requests, pool, 3)
    two = P.sample_speakers(requests.repartition(7), pool.repartition(3), 3)
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    counts = [r["n"] for r in one.filter("gender = 'f'").groupBy("speaker_id").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 20 and min(counts) > 8 and max(counts) < 45  # 22.5 on average


def test_cluster_shortlists(spark):
    clusters = spark.createDataFrame([(c, c, "f" if c < 4 else "m") for c in range(6)], "cluster int, density_pos int, gender string")
    sparse = {(r["gender"], r["cluster"]) for r in P.candidate_clusters(clusters, P.SPARSE, 2).collect()}
    dense = {(r["gender"], r["cluster"]) for r in P.candidate_clusters(clusters, P.DENSE, 2).collect()}
    assert sparse == {("f", 0), ("f", 1), ("m", 4), ("m", 5)} and dense == {("f", 2), ("f", 3), ("m", 4), ("m", 5)}
    with pytest.raises(ValueError):
        P.candidate_clusters(clusters, "other")


def test_ties_and_open_gender(spark, pool):
    pitch = pool.select("speaker_id", F.lit(5.0).alias("m"), F.lit(0.1).alias("s"), F.lit(10).alias("w"))
    asked = spark.createDataFrame([(1, None), (2, "any"), (3, "m")], "seed int, gender string").withColumn("asked", F.coalesce("gender", F.lit("-")))
    out = {r["asked"]: r for r in P.generate_pseudospeakers(asked, pool, pitch, 2).collect()}
    assert set(out) == {"-", "any", "m"} and out["m"]["gender"] == "m"
    assert all(len(r["selected"]) == 2 and r["std"] == pytest.approx(0.1) for r in out.values())
    mixed = spark.createDataFrame([("f",), ("m",)], "gender string").withColumn("k", F.lit(1))
    assert P.majority_gender(mixed, ["k"]).first()["gender"] == "f"
