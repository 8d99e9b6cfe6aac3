"""Exact dedup: heavy hitters are removed map-side by broadcast winners, the rest meets in an ordinary shuffle.

Texts are equal when they are identical without ASCII white space; they are known by
the SHA-256 of that form. A frequent-items sketch (Misra-Gries counters with the
decrements by a median counter, mergeable) runs map-side over the digests and is
merged in two steps. Its candidates are counted exactly, and the verified ones with
their winners, ``HEAVY`` rows at most, are broadcast: every row of such a group is
decided where it stands. A digest in no candidate list has at most about 4 / COUNTERS
of all rows, so what is left shuffles evenly.

Only DataFrame functions. Defined cases: a null text is an empty one, and all empty
texts are equal; of equal texts the one with the most code points in the original
stays, then the smallest id (a null id last), then one row of several that share both;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Counters of the sketch; candidates that are verified and broadcast; sketches merged before the last merge.
COUNTERS, HEAVY, SPREAD = 8192, 1024, 64


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _facts(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return [F.col(id_col).alias("id"), F.length(body).alias("n_chars"), F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest")]


def heavy_digests(rows: DataFrame) -> DataFrame:
    """Hashes of the digests that may be frequent: one column ``item``, HEAVY rows at most."""
    parts = rows.select("digest", (F.spark_partition_id() % SPREAD).alias("part")).groupBy("part").agg(
        F.expr(f"approx_top_k_accumulate(xxhash64(digest), {COUNTERS})").alias("sketch"))
    # Grouped by a constant: without rows there is no sketch to estimate from.
    merged = parts.groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch"))
    found = merged.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {HEAVY})")).alias("found"))
    # A count of one is no copy; the estimates never fall below the true counts by more than the sketch's error.
    return found.filter("found.count > 1").select("found.item")


def winners(rows: DataFrame) -> DataFrame:
    """digest, best (the row that stays) and group_size of every digest, combined map-side."""
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("id").isNull().alias("unnamed"), "id", "row")).alias("best")
    return rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("group_size"))


def decide(rows: DataFrame) -> DataFrame:
    """``rows`` (id, n_chars, digest and a unique ``row``) with keep_id, group_size and kept."""
    candidates = F.broadcast(heavy_digests(rows))
    heavy = winners(rows.join(candidates, F.xxhash64("digest") == F.col("item"), "left_semi")).filter("group_size > 1")
    heavy = materialize(heavy, "heavy-digests")  # HEAVY rows at most, but for digests that share a 64-bit hash
    decided = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    decided = decided.unionByName(rest.join(winners(rest), "digest"))
    return decided.select(*rows.columns, F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept and the binary digest."""
    rows = docs.select(*_facts(docs, id_col, text)).withColumn("row", F.monotonically_increasing_id())
    decided = decide(materialize(rows, "digests"))
    return decided.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Texts are written once and not shuffled for their digests."""
    held = docs.select(*_facts(docs, id_col, text), F.struct(*docs.columns).alias("doc")).withColumn("row", F.monotonically_increasing_id())
    held = materialize(held, "numbered")
    gone = decide(held.drop("doc")).filter(~F.col("kept")).select("row")
    return held.select("row", "doc").join(gone, "row", "left_anti").select("doc.*")
