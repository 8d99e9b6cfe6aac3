import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import mixing as M

DIM, LEVELS, SIZE = 6, 3, 5


@pytest.fixture(scope="module")
def book():
    return np.random.default_rng(1).normal(size=(LEVELS, SIZE, DIM))


@pytest.fixture(scope="module")
def codebook(spark, book):
    rows = [(q, c, [float(x) for x in book[q, c]]) for q in range(LEVELS) for c in range(SIZE)]
    return spark.createDataFrame(rows, "q int, code int, vec array<double>")


def frame_table(spark, arrays):
    rows = [(u, i, [float(x) for x in v]) for u, a in arrays.items() for i, v in enumerate(a)]
    return spark.createDataFrame(rows, "utt_id bigint, frame bigint, vec array<double>").repartition(3)


@pytest.fixture(scope="module")
def streams():
    rng = np.random.default_rng(2)
    a = {0: rng.normal(size=(30, DIM)), 1: rng.normal(size=(9, DIM))}
    b = {0: rng.normal(size=(26, DIM)), 1: rng.normal(size=(12, DIM))}
    b[0][4] = 2.0  # no variance
    return a, b


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_encode_decode(spark, codebook, book, streams, limit):
    vecs = frame_table(spark, streams[0])
    coded = M.rvq_encode(vecs, codebook, LEVELS, limit)
    decoded = M.rvq_decode(coded.withColumnRenamed("vec", "x"), codebook, LEVELS, limit).collect()
    assert len(decoded) == 39
    for r in decoded:
        left, codes = np.array(r["x"]), []
        for q in range(LEVELS):
            codes.append(int(((book[q] - left) ** 2).sum(1).argmin()))
            left = left - book[q][codes[-1]]
        assert list(r["codes"]) == codes
        np.testing.assert_allclose(r["vec"], sum(book[q][c] for q, c in enumerate(codes)))


def test_assignment_in_parts(spark, streams):
    vecs = frame_table(spark, streams[0])
    centres = vecs.filter("utt_id = 1").select((F.col("frame") * 3).alias("id"), "vec")
    whole = {tuple(r) for r in M.assign_clusters(vecs, centres).select("utt_id", "frame", "cluster").collect()}
    parts = {tuple(r) for r in M.assign_clusters(vecs, centres, limit_bytes=200).select("utt_id", "frame", "cluster").collect()}
    assert whole == parts and len(whole) == 39


@pytest.mark.parametrize("shift", [0, 2])
def test_windowed_correlation(spark, streams, shift):
    a, b = streams
    got = {(r["utt_id"], r["frame"]): r["corr"]
           for r in M.windowed_corr(frame_table(spark, b), frame_table(spark, a), max_shift=shift, block=4).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        for u in a:
            t = min(len(a[u]), len(b[u]))
            for i in range(t):
                near = a[u][max(0, i - shift):min(t, i + shift + 1)]
                want = np.max([np.corrcoef(b[u][i], y)[0, 1] for y in near])
                assert got.pop((u, i)) == pytest.approx(want, abs=1e-9, nan_ok=True)
    assert not got


def test_admixture_limits_and_gate(spark, streams):
    a, b = frame_table(spark, streams[0]), frame_table(spark, streams[1])
    assert M.admix(a, b, 0.0, 5).filter("from_syn").count() <= 0
    assert M.admix(a, b, 1.0, 5).filter("not from_syn").count() == 0
    corr = M.windowed_corr(b, a)
    gated = M.admix(a, b, 1.0, 5, corr=corr)
    assert gated.filter("from_syn and corr < 0.6").count() == 0
    # A vector without variance has no correlation and passes.
    assert gated.filter("utt_id = 0 and frame = 4 and from_syn and isnan(corr)").count() == 1


def test_repair_takes_whole_columns(spark):
    syn = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [1024, 3]), (1, 0, [5, -1])], "utt_id bigint, frame bigint, codes array<int>")
    orig = spark.createDataFrame([(0, 0, [7, 7]), (0, 1, [8, 8]), (1, 0, [9, 9])], "utt_id bigint, frame bigint, codes array<int>")
    got = sorted(tuple(r) for r in M.repair_columns(syn, orig, 2).select("utt_id", "frame", "codes").collect())
    assert got == [(0, 0, [7, 2]), (0, 1, [8, 3]), (1, 0, [5, -1])]


def test_residual_shrinks_with_levels(spark, streams):
    vecs = frame_table(spark, streams[0])
    fitted = M.fit_codebook(vecs, k=4, levels=2, seed=3, max_iter=5)
    assert fitted.count() == 8
    sims = {r["level"]: r["similarity"] for r in M.rvq_level_similarity(
        vecs, M.rvq_encode(vecs, fitted, 2), fitted, 2).collect()}
    assert sims[1] > sims[0]
