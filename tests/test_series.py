import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import series as S


@pytest.fixture(scope="module")
def contours():
    rng = np.random.default_rng(3)
    out = {}
    for utt, n in enumerate([1, 2, 7, 40, 90, 133]):
        f0 = np.round(rng.uniform(60, 300, n), 2)
        f0[rng.random(n) < 0.25] = 0.0
        out[utt] = f0
    out[6] = np.zeros(5)
    return out


@pytest.fixture(scope="module")
def frames(spark, contours):
    rows = [(u, i, float(x)) for u, f0 in contours.items() for i, x in enumerate(f0)]
    return spark.createDataFrame(rows, "utt_id bigint, frame bigint, f0 double").repartition(4)


def series(df, value="f0"):
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["utt_id"], {})[r["frame"]] = r[value]
    for u, d in out.items():
        assert sorted(d) == list(range(len(d))), u
    return {u: np.array([d[i] for i in sorted(d)]) for u, d in out.items()}


@pytest.mark.parametrize("n", [1, 2, 13, 60, 301])
def test_resample_matches_interp(frames, contours, n):
    got = series(S.resample_linear(frames, n, block=8))
    for u, f0 in contours.items():
        want = np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(f0)), f0)
        np.testing.assert_allclose(got[u], want, atol=1e-9)


@pytest.mark.parametrize("n", [2, 13, 150])
def test_resample_clamped(frames, contours, n):
    got = series(S.resample_linear(frames, n, clamp_end=True, block=8))
    for u, f0 in contours.items():
        want = np.interp(np.linspace(0, len(f0), n), np.arange(len(f0)), f0)
        np.testing.assert_allclose(got[u], want, atol=1e-9)


@pytest.mark.parametrize("n", [3, 4, 32, 64])
def test_smoothing_matches_convolution(frames, contours, n):
    got = series(S.smooth_voiced(frames, n, 0.75, block=8))
    for u, f0 in contours.items():
        voiced = f0[f0 != 0]
        want = f0.copy()
        if len(voiced):
            k = min(n, len(voiced))
            want[f0 != 0] = 0.25 * voiced + 0.75 * np.convolve(voiced, np.ones(k) / k, mode="same")
        np.testing.assert_allclose(got[u], want, atol=1e-9)


def test_converted_pitch_has_target_statistics(frames):
    out = series(S.convert_pitch(frames, F.lit(5.1), F.lit(0.3), block=8))
    logs = np.log(out[5][out[5] != 0])
    assert logs.mean() == pytest.approx(5.1) and logs.std() == pytest.approx(0.3)
    assert (out[6] == 0).all()


def test_noise_does_not_depend_on_partitions(frames):
    one = series(S.add_noise(frames.repartition(1), 2.0, 9))
    many = series(S.add_noise(frames.repartition(13), 2.0, 9))
    for u in one:
        np.testing.assert_allclose(one[u], many[u], rtol=1e-12)
        assert (one[u] >= 0).all()
    other = series(S.add_noise(frames, 2.0, 10))
    assert not np.allclose(one[5], other[5])


@pytest.mark.parametrize("chunk,overlap", [(10, None), (10, 4), (9, 3), (40, None)])
def test_overlap_add(frames, contours, chunk, overlap):
    got = series(S.overlap_add(frames, chunk, overlap, block=8))
    step = chunk - (chunk // 2 if overlap is None else overlap)
    for u, x in contours.items():
        if len(x) <= chunk:
            np.testing.assert_allclose(got[u], x, atol=1e-9)
            continue
        total, weight = np.zeros(len(x) + 2 * chunk), np.zeros(len(x) + 2 * chunk)
        for start in range(0, len(x), step):
            piece = np.zeros(chunk)
            piece[: len(x[start:start + chunk])] = x[start:start + chunk]
            total[start:start + chunk] += piece * np.hanning(chunk)
            weight[start:start + chunk] += np.hanning(chunk)
        weight[weight == 0] = 1.0
        np.testing.assert_allclose(got[u], (total / weight)[: len(x)], atol=1e-6)


def test_overlap_add_with_upsampling_function(frames, contours):
    def double(chunks):
        return chunks.withColumn("pos", F.explode(F.array(F.col("pos") * 2, F.col("pos") * 2 + 1)))

    got = series(S.overlap_add(frames, 200, fn=double, rate=2))
    for u, x in contours.items():
        np.testing.assert_allclose(got[u], np.repeat(x, 2))


def test_standardize_round_trip(frames):
    stats = S.f0_stats(frames).first()
    z = S.standardize_f0(frames, 100.0, block=8)
    back = S.destandardize_f0(z, F.lit(stats["mean"]), F.lit(stats["std"]))
    means = back.filter("f0 <> 0").groupBy("utt_id").agg(F.avg("f0").alias("m")).collect()
    assert all(r["m"] == pytest.approx(100.0) for r in means)
