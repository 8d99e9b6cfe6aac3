"""Embedding whitening: Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Vectors are scaled to integers, ``x = floor(256 * c)``; the fit list holds each distinct
x once. Two products alternate over it, each one pass: ``u = X v`` and ``X'u`` on
centred rows, both fully reorthogonalised. The vectors v and the small matrices stay
on the driver. A vector u has an entry per row and is never gathered: as a
combination ``u = X w`` it is carried by its w, and every task works its own entries
out again, so a lost executor costs nothing but its tasks. The SVD of the small bidiagonal
matrix gives components and deviations.

The recurrence ends when the leading values have converged and all variance not yet
seen is less than the last of them (so none can be missing), or when the space is
exhausted. A direction that closes an invariant space is followed by a fresh one, so
equal eigenvalues are all found.

Defined cases: vectors that are null or hold a null or non-finite entry are left out;
shorter vectors count as padded with zeros; components of no variance are not
numbered (fewer than two distinct vectors give no rows); rows that share an id are
whitened each; a deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .words import small_batches, tidy

SCALE = 256


@dataclass
class Whitening:
    """n and sums of the fit list; components by column, their eigenvalues, the trace, and the error of the result."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def scaled(self) -> np.ndarray:
        """Whitened coordinates are centred rows times this matrix."""
        return self.components / np.sqrt(self.values)


def scaled_entries(vector: str) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))))


def usable(vector: str) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, finite), F.lit(False))


def matrix(column) -> np.ndarray:
    """Rows of a list column whose lists are of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(fit: DataFrame, work, size: int) -> np.ndarray:
    """The sum over all rows of ``work(rows) -> size numbers``, added up by number, not by task."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += work(matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "value"])

    got = fit.select("x").mapInArrow(tidy(run), "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size)
    out[got.column("i").to_numpy()] = got.column("value").to_numpy()
    return out


def product(fit: DataFrame, mean: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(U'u, X'u) for the columns U = X ws and u the last of them: one pass."""
    sent = fit.sparkSession.sparkContext.broadcast((mean, ws))

    def work(x):
        mean, ws = sent.value
        rows = x - mean
        u = rows @ ws
        return np.concatenate([u.T @ u[:, -1], rows.T @ u[:, -1]])

    got = summed(fit, work, ws.shape[1] + len(mean))
    sent.unpersist()
    return got[: ws.shape[1]], got[ws.shape[1] :]


def bidiagonalise(fit: DataFrame, mean: np.ndarray, total: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors, singular values) of the centred rows whose squared norm is ``total``, k at most."""
    d = len(mean)
    small = np.finfo(float).eps * d * total**0.5
    rng = np.random.default_rng(1)

    def fresh(vs):
        v = rng.standard_normal(d)
        for _ in range(3):
            v -= vs @ (vs.T @ v)
        return v / np.linalg.norm(v)

    v, beta = fresh(np.zeros((d, 0))), 0.0
    vs, ws, images, alphas, betas = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0)), [], []
    while True:
        # u = X v - beta u_before, made orthogonal to all u before.
        w = v - beta * ws[:, -1] if beta else v
        h, _ = product(fit, mean, np.column_stack([ws, w]))
        w = w - ws @ h[:-1]
        h, image = product(fit, mean, np.column_stack([ws, w]))
        w, image = w - ws @ h[:-1], image - images @ h[:-1]
        alpha = max(0.0, h[-1] - float(h[:-1] @ h[:-1])) ** 0.5
        if alpha <= small:
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        vs, ws, images = np.column_stack([vs, v]), np.column_stack([ws, w]), np.column_stack([images, image])
        alphas.append(alpha)
        # v = X'u - alpha v_before, made orthogonal to all v before.
        v = image - alpha * vs[:, -1]
        for _ in range(2):
            v = v - vs @ (vs.T @ v)
        beta = float(np.linalg.norm(v))
        small_side = np.diag(alphas) + np.diag(betas, 1)
        left, values, right = np.linalg.svd(small_side)
        if len(alphas) == d:
            break
        seen = values[:k]
        settled = len(seen) == k and (beta * np.abs(left[-1, :k]) <= 4 * np.finfo(float).eps * values[0]).all()
        if settled and total - float(values @ values) < 0.999 * seen[-1] ** 2:
            break
        if beta <= small:
            v, beta = fresh(vs), 0.0
        else:
            v = v / beta
        betas.append(beta)
    many = int((values[:k] > small).sum())
    return vs @ right[:many].T, values[:many]


def fit_whitening(rows: DataFrame, n_components: int = 4, vector: str = "embedding") -> Whitening:
    """The whitening of the distinct scaled vectors of ``rows``."""
    small_batches(rows.sparkSession)
    found = rows.filter(usable(vector)).select(scaled_entries(vector).alias("x"))
    d = found.agg(F.max(F.size("x"))).first()[0] or 0
    fit = materialize(_padded(found, d).distinct(), "fit-vectors")
    sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("c").alias("n")).collect()
    n, totals = (sums[0]["n"], {r["i"]: int(r["s"]) for r in sums}) if sums else (0, {})
    model = Whitening(n, [totals[i] for i in range(len(totals))], np.zeros((d, 0)), np.zeros(0), 0.0)
    if n < 2:
        return model
    mean = model.mean
    total = float(summed(fit, lambda x: ((x - mean) ** 2).sum(axis=0), d).sum())
    model.trace = total / n
    if total > 0:
        model.components, values = bidiagonalise(fit, mean, total, min(n_components, d))
        model.values = values**2 / n
        scaled, k = model.scaled, len(values)

        def moments(x):
            z = (x - mean) @ scaled
            return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

        got = summed(fit, moments, k + k * k) / n
        covariance = got[k:].reshape(k, k) - np.outer(got[:k], got[:k])
        model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def _padded(rows: DataFrame, d: int) -> DataFrame:
    short = F.array_repeat(F.lit(0).cast("long"), (F.lit(d) - F.size("x")).cast("int"))
    return rows.withColumn("x", F.when(F.size("x") < d, F.concat("x", short)).otherwise(F.slice("x", 1, max(d, 1))))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over the entries of (n * x - sums) ** 2."""
    about = (n * x.astype(float) - np.array(sums, float)) ** 2
    if about.sum(axis=1).max(initial=0) < 2.0**61:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows id, component, n, deviation, whitened, explained, identity_error: one per usable vector and component."""
    small_batches(rows.sparkSession)
    k, d = len(model.values), len(model.sums)
    source = _padded(rows.filter(usable(vector)).select(F.col(id_col).alias("id"), scaled_entries(vector).alias("x")), d)
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = [rows.schema[id_col].dataType, T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    explained = model.values / model.trace if k else np.zeros(0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = matrix(batch.column("x")) if batch.num_rows and k else np.zeros((0, d), np.int64)
            m = len(x)
            z = (x - model.mean) @ model.scaled if m else np.zeros((0, k))
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n)),
                pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(z.ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, model.identity_error))], names)

    return source.mapInArrow(tidy(run), T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)]))
