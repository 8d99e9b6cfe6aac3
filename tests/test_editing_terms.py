"""What a dictionary of terms and the tables between may take when they are sent to every task."""

from pyspark.sql import functions as F

from framewright.operators import editing as E
from framewright.operators.scans import bounded_broadcast
from framewright.session import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_packed_files_are_not_broadcast(spark):
    """Files of a few megabytes hold far more rows than a broadcast of that size should."""
    rows = materialize(spark.range(1_000_000).select((F.col("id") % 4).alias("k"), F.expr("id div 4").alias("v")), "packed")
    found = plan(rows.join(rows.groupBy("k", "v").agg(F.count("*").alias("n")), ["k", "v"]))
    assert "SortMergeJoin" in found and "BroadcastExchange" not in found


def test_large_dictionaries_are_joined(spark, monkeypatch):
    """150,000 short terms stay below 64 MB as texts, but not as rows of a hash table."""
    seen = []

    def spy(df, size, limit):
        out = bounded_broadcast(df, size, limit)
        seen.append(out is not df)
        return out

    monkeypatch.setattr(E, "bounded_broadcast", spy)
    words = spark.range(150_000).select(F.lit(0).alias("utt_id"), F.col("id").alias("word_idx"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("word"))
    out = E.tag_entities(words, dictionary=words.select(F.col("word").alias("term"), F.lit("T").alias("label")))
    assert out.count() == 150_000 and not any(seen)
