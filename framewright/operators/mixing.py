"""Residual codes, vector streams and per-frame mixing of two streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from framewright.functions import rng
from framewright.functions.vectors import add, cosine, dot, subtract, unit
from framewright.operators.scans import (
    BLOCK, attach, bounded_broadcast, number_rows, with_neighbours, with_totals)
from framewright.session import materialize

EOS = 1024
MASKED = -1
GATE = 0.6
VECTOR_BLOCK = 4096  # frames per window block when rows carry vectors
CODEBOOK_LIMIT = 256 << 20  # bytes a codebook may take to be sent to every task


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _vector_bytes(col: str) -> Column:
    return F.size(col) * 8 + 64


def rvq_decode(codes: DataFrame, codebook: DataFrame, levels: int,
               limit_bytes: int = CODEBOOK_LIMIT) -> DataFrame:
    """Add ``vec`` = sum over the levels of the coded vectors; null if a code is unknown.

    Each level is its own lookup, so with a codebook under the limit the frames
    are never shuffled. A larger codebook takes the same lookups as shuffle joins.
    """
    out = codes
    for q in range(levels):
        level = codebook.filter(F.col("q") == q).select(
            F.col("code").alias("_code"), F.col("vec").alias(f"_v{q}"))
        level = bounded_broadcast(level, _vector_bytes(f"_v{q}"), limit_bytes // levels)
        out = out.join(level, F.col("codes")[q] == F.col("_code"), "left").drop("_code")
    total = F.col("_v0")
    for q in range(1, levels):
        total = add(total, F.col(f"_v{q}"))
    return out.withColumn("vec", total).drop(*[f"_v{q}" for q in range(levels)])


def _matrix(rows, col: str = "vec") -> np.ndarray:
    return np.array([r[col] for r in rows], dtype=np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray, tile: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, row) of the nearest centre of each vector; ties go to the lower row.

    The one distance formula of encoding and assignment, in tiles of vectors and
    centres, so that memory does not grow with their number.
    """
    least, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for r in range(0, len(x), tile):
        part = x[r : r + tile]
        size = (part ** 2).sum(1)[:, None]
        for c in range(0, len(centres), tile):
            near = centres[c : c + tile]
            d2 = size - 2.0 * part @ near.T + (near ** 2).sum(1)[None, :]
            found = d2.argmin(axis=1)
            d2 = d2[np.arange(len(part)), found]
            better = d2 < least[r : r + tile]
            least[r : r + tile][better] = d2[better]
            at[r : r + tile][better] = found[better] + c
    return least, at


def _nearest_udf(shared):
    @F.pandas_udf("struct<id: bigint, d2: double>")
    def nearest(col: pd.Series) -> pd.DataFrame:
        known, centres = shared.value
        d2, at = _nearest(np.stack(col.to_numpy()).astype(np.float64), centres)
        return pd.DataFrame({"id": known[at], "d2": d2})

    return nearest


def assign_clusters(vecs: DataFrame, centres: DataFrame, out: str = "cluster",
                    limit_bytes: int = CODEBOOK_LIMIT) -> DataFrame:
    """Add the id of the nearest centre (columns ``id``, ``vec``); ties go to the lowest id.

    Centres reach the tasks in parts of at most ``limit_bytes``. With several
    parts each pass writes the best so far, so that only one part is held at a time.
    """
    spark = vecs.sparkSession
    total = centres.agg(F.sum(_vector_bytes("vec")).alias("b")).first()["b"] or 0
    parts = max(1, -(-total // limit_bytes))
    rows = vecs.withColumn("_best", F.lit(None).cast("struct<id: bigint, d2: double>"))
    for i in range(parts):
        part = centres.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == i).orderBy("id").collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in part], dtype=np.int64), _matrix(part)))
        rows = rows.withColumn("_new", _nearest_udf(shared)(F.col("vec")))
        better = F.col("_best").isNull() | (F.col("_new.d2") < F.col("_best.d2")) | (
            (F.col("_new.d2") == F.col("_best.d2")) & (F.col("_new.id") < F.col("_best.id")))
        rows = rows.withColumn("_best", F.when(better, F.col("_new")).otherwise(F.col("_best"))).drop("_new")
        if parts > 1:
            rows = materialize(rows, "nearest-pass")
            shared.unpersist()
    return rows.withColumn(out, F.col("_best.id")).drop("_best")


def rvq_encode(vecs: DataFrame, codebook: DataFrame, levels: int,
               limit_bytes: int = CODEBOOK_LIMIT) -> DataFrame:
    """Add ``codes``: at each level the nearest codebook vector to what is left of the vector."""
    total = codebook.agg(F.sum(_vector_bytes("vec")).alias("b")).first()["b"] or 0
    if total > limit_bytes:
        rows = vecs.withColumn("_vec", F.col("vec"))
        for q in range(levels):
            level = codebook.filter(F.col("q") == q).select(F.col("code").alias("id"), "vec")
            rows = assign_clusters(rows, level, f"_c{q}", limit_bytes)
            rows = rows.join(level.select(F.col("id").alias(f"_c{q}"), F.col("vec").alias("_near")), f"_c{q}")
            rows = rows.withColumn("vec", subtract(F.col("vec"), F.col("_near"))).drop("_near")
        rows = rows.withColumn("codes", F.array(*[F.col(f"_c{q}").cast("int") for q in range(levels)]))
        return rows.drop("vec", *[f"_c{q}" for q in range(levels)]).withColumnRenamed("_vec", "vec")

    books, ids = [], []
    for q in range(levels):
        part = codebook.filter(F.col("q") == q).orderBy("code").collect()
        books.append(_matrix(part))
        ids.append(np.array([r["code"] for r in part], dtype=np.int32))
    shared = vecs.sparkSession.sparkContext.broadcast((books, ids))

    @F.pandas_udf("array<int>")
    def encode(col: pd.Series) -> pd.Series:
        left = np.stack(col.to_numpy()).astype(np.float64)
        picked = []
        for book, known in zip(*shared.value):
            at = _nearest(left, book)[1]
            picked.append(known[at])
            left = left - book[at]
        return pd.Series(list(np.stack(picked, axis=1)))

    return vecs.withColumn("codes", encode("vec"))


def lloyd_steps(vecs: DataFrame, start: DataFrame, levels: int = 1, steps: int = 10) -> DataFrame:
    """Codebook (q, code, vec, n) after a fixed number of k-means steps from given first centres.

    ``start``: q, code, vec. A centre without members stays where it is; ``n``
    counts the members at the last step.
    """
    left, out = vecs.select(F.col("vec").cast("array<double>").alias("vec")), None
    for q in range(levels):
        centres = start.filter(F.col("q") == q).select(F.col("code").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
        for _ in range(steps):
            placed = assign_clusters(left, centres, "id")
            means = placed.groupBy("id").agg(vector_to_array(Summarizer.mean(array_to_vector("vec"))).alias("_mean"), F.count(F.lit(1)).alias("n"))
            centres = materialize(centres.select("id", "vec").join(means, "id", "left").select(
                "id", F.coalesce("_mean", "vec").alias("vec"), F.coalesce("n", F.lit(0)).alias("n")), "centres")
        book = centres.select(F.lit(q).alias("q"), F.col("id").alias("code"), "vec", "n")
        out = book if out is None else out.unionByName(book)
        if q + 1 < levels:
            near = bounded_broadcast(centres.select("id", F.col("vec").alias("_near")), _vector_bytes("_near"), CODEBOOK_LIMIT)
            left = materialize(assign_clusters(left, centres.select("id", "vec"), "id").join(near, "id").select(
                subtract(F.col("vec"), F.col("_near")).alias("vec")), "residuals")
    return out


def fit_codebook(vecs: DataFrame, k: int, levels: int = 1, seed: int = 0, max_iter: int = 20) -> DataFrame:
    """k-means codebook per residual level with seeded random first centres: q, code, vec."""
    spark = vecs.sparkSession
    left = vecs.select(F.col("vec").cast("array<double>").alias("vec"))
    books = []
    for q in range(levels):
        rows = left.withColumn("features", array_to_vector("vec")).persist(StorageLevel.MEMORY_AND_DISK)
        model = KMeans(k=k, seed=seed + q, maxIter=max_iter).fit(rows)
        centres = spark.createDataFrame(
            [(q, i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
            "q int, code int, vec array<double>")
        books.append(centres)
        if q + 1 < levels:
            near = centres.select(F.col("code").alias("prediction"), F.col("vec").alias("_near"))
            near = bounded_broadcast(near, _vector_bytes("_near"), CODEBOOK_LIMIT)
            left = materialize(model.transform(rows).join(near, "prediction").select(
                subtract(F.col("vec"), F.col("_near")).alias("vec")), "residuals")
        rows.unpersist()
    out = books[0]
    for book in books[1:]:
        out = out.unionByName(book)
    return out


def repair_columns(syn: DataFrame, orig: DataFrame, levels: int, keys="utt_id",
                   block: int = BLOCK) -> DataFrame:
    """Replace the code columns of ``syn`` that an end marker damaged by those of ``orig``.

    Only recordings with the marker in level 0 are touched; there every column
    holding a marker or a masked code anywhere is taken from ``orig`` as a whole.
    """
    keys = _keys(keys)
    bad = F.lit(0)
    for q in range(levels):
        bad = bad + F.when(F.col("codes")[q].isin(EOS, MASKED), 1 << q).otherwise(0)
    rows = with_totals(
        syn, keys, [F.bit_or(bad).alias("_bad"), F.bool_or(F.col("codes")[0] == EOS).alias("_hit")],
        block=block)
    other = orig.select(*keys, "frame", F.col("codes").alias("_orig"))
    rows = rows.join(other, [*keys, "frame"], "left")
    fixed = F.array(*[
        F.when(F.col("_hit") & (F.col("_bad").bitwiseAND(1 << q) != 0), F.col("_orig")[q])
        .otherwise(F.col("codes")[q]) for q in range(levels)])
    return rows.withColumn("codes", fixed).drop("_bad", "_hit", "_orig")


def windowed_corr(syn: DataFrame, orig: DataFrame, keys="utt_id", max_shift: int = 2,
                  metric: str = "pearson", block: int = VECTOR_BLOCK) -> DataFrame:
    """keys, frame, corr: best correlation of a frame with the frames within ``max_shift`` of the other stream.

    Vectors are centred and scaled once; both streams then share one window, so
    neither is multiplied by the shifts. NaN (no variance) wins the maximum.
    """
    keys = _keys(keys)
    centre = metric == "pearson"
    both = syn.select(*keys, "frame", F.lit(True).alias("_syn"), unit(F.col("vec"), centre).alias("_u")).unionByName(
        orig.select(*keys, "frame", F.lit(False).alias("_syn"), unit(F.col("vec"), centre).alias("_u")))
    both = with_totals(
        both, keys,
        [F.max(F.when(F.col("_syn"), F.col("frame"))).alias("_ls"),
         F.max(F.when(~F.col("_syn"), F.col("frame"))).alias("_lo")], block=block)
    both = both.filter(F.col("frame") <= F.least("_ls", "_lo"))
    near = with_neighbours(
        both, keys,
        {"_near": lambda w: F.collect_list(F.when(~F.col("_syn"), F.col("_u"))).over(
            w.rangeBetween(-max_shift, max_shift))},
        max_shift, max_shift, block=block)
    best = F.array_max(F.transform("_near", lambda o: dot(o, F.col("_u"))))
    return near.filter("_syn").select(*keys, "frame", best.alias("corr"))


def admix(orig: DataFrame, syn: DataFrame, ratio: Column | float, seed: Column | int, keys="utt_id",
          corr: DataFrame | None = None, tau: float = GATE) -> DataFrame:
    """Per frame, the original vector if the draw exceeds ``ratio`` or the gate rejects, else the other.

    ``corr`` (from ``windowed_corr``) switches the gate on: below ``tau`` rejects, NaN passes.
    """
    keys = _keys(keys)
    ratio = F.lit(ratio) if isinstance(ratio, (int, float)) else ratio
    rows = orig.join(syn.select(*keys, "frame", F.col("vec").alias("_syn")), [*keys, "frame"])
    keep = rng.uniform(seed, *[F.col(k) for k in keys], F.col("frame")) > ratio
    if corr is not None:
        rows = rows.join(corr, [*keys, "frame"])
        keep = keep | (F.col("corr") < tau)
    return rows.withColumn("from_syn", ~keep).withColumn(
        "vec", F.when(keep, F.col("vec")).otherwise(F.col("_syn"))).drop("_syn")


def assemble_frames(vec: DataFrame, f0: DataFrame, speaker: DataFrame, keys="utt_id",
                    block: int = BLOCK) -> DataFrame:
    """Model input per frame: ``[vec ; f0 ; speaker vector]``."""
    keys = _keys(keys)
    rows = vec.select(*keys, "frame", "vec").join(f0.select(*keys, "frame", "f0"), [*keys, "frame"])
    rows = attach(rows, speaker.select(*keys, "xvector"), keys, block=block)
    return rows.select(*keys, "frame", F.concat("vec", F.array("f0"), "xvector").alias("input"))


def keyed_cosine(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Cosine of the two vectors of each key."""
    keys = _keys(keys)
    return a.select(*keys, F.col("vec").alias("_a")).join(
        b.select(*keys, F.col("vec").alias("_b")), keys).select(
        *keys, cosine(F.col("_a"), F.col("_b")).alias("similarity"))


def rvq_level_similarity(vecs: DataFrame, codes: DataFrame, codebook: DataFrame, levels: int,
                         keys="utt_id", limit_bytes: int = CODEBOOK_LIMIT) -> DataFrame:
    """level, similarity: cosine of the vector with the sum of its first levels.

    Averaged per recording first, then over recordings.
    """
    keys = _keys(keys)
    rows = vecs.join(codes.select(*keys, "frame", "codes"), [*keys, "frame"])
    partial, cosines = None, []
    for q in range(levels):
        level = codebook.filter(F.col("q") == q).select(
            F.col("code").alias("_code"), F.col("vec").alias(f"_v{q}"))
        level = bounded_broadcast(level, _vector_bytes(f"_v{q}"), limit_bytes // levels)
        rows = rows.join(level, F.col("codes")[q] == F.col("_code")).drop("_code")
        partial = F.col(f"_v{q}") if partial is None else add(partial, F.col(f"_v{q}"))
        cosines.append(cosine(F.col("vec"), partial))
    per_recording = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_s{q}") for q, c in enumerate(cosines)])
    stacked = per_recording.select(F.posexplode(F.array(*[f"_s{q}" for q in range(levels)])).alias("level", "_s"))
    return stacked.groupBy("level").agg(F.avg("_s").alias("similarity"))


def mean_vector(df: DataFrame, keys) -> DataFrame:
    """Mean vector per key; partial sums combine map-side."""
    return df.groupBy(*_keys(keys)).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>")))).alias("vec"))


def pack_batches(df: DataFrame, id_col: str, values: str, size: int, mode: str = "pad", pad=0) -> DataFrame:
    """Batches of similar length: longest first, padded to the longest or cut to the shortest of the batch."""
    rows = number_rows(df.withColumn("length", F.size(values)), [-F.col("length"), F.col(id_col)], out="_no")
    rows = rows.withColumn("batch", F.expr(f"_no div {size}")).withColumn("slot", F.col("_no") % size)
    batch = W.partitionBy("batch")  # at most ``size`` rows
    if mode == "pad":
        rows = rows.withColumn("_to", F.max("length").over(batch))
        out = F.concat(values, F.array_repeat(F.lit(pad), F.col("_to") - F.col("length")))
    else:
        rows = rows.withColumn("_to", F.min("length").over(batch))
        out = F.slice(values, 1, F.col("_to"))
    return rows.withColumn(values, out).drop("_no", "_to")
