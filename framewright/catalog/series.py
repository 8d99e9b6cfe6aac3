"""Registered queries: F0 and numeric series (inventory section 2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query, r4, r6, sql_normal
from framewright.operators import series as S
from framewright.operators.scans import attach
from framewright.plans import bindings as B

_FR = f"WITH {B.FRAMES}"
_KEEP = ["utt_id", "frame", "f0"]
# The edges of the pitch buckets, written out once more for the SQL.
_EDGES = [10, 100.89050217, 115.1907547, 127.34055481, 142.26394958, 161.6648941, 180.98721313, 199.32779541, 221.38771667,
          252.21411438, 803.56750488]


def _f0(spark, sf):
    return B.frames(spark, sf).select(*_KEEP)


@query("F1_resample_linear", f"""{_FR},
n AS (SELECT utt_id, count(*) AS m, (count(*) * 3) // 2 + utt_id % 3 AS n FROM frames GROUP BY utt_id),
t AS (SELECT utt_id, m, n, unnest(range(0, n)) AS frame FROM n),
p AS (SELECT *, (frame * (m - 1)) // (n - 1) AS lo, (frame * (m - 1)) % (n - 1) AS rem FROM t)
SELECT p.utt_id, p.frame, {r6('a.f0 + p.rem / (p.n - 1)::DOUBLE * (coalesce(b.f0, a.f0) - a.f0)')} AS f0
FROM p JOIN frames a ON a.utt_id = p.utt_id AND a.frame = p.lo
LEFT JOIN frames b ON b.utt_id = p.utt_id AND b.frame = p.lo + 1""")
def resample(spark, sf):
    rows = _f0(spark, sf)
    want = rows.groupBy("utt_id").agg(
        (F.expr("count(1) * 3 div 2") + F.col("utt_id") % 3).alias("want"))
    out = S.resample_linear(attach(rows, want, "utt_id"), F.col("want"))
    return out.withColumn("f0", B.r6(F.col("f0")))


@query("F1_resample_clamped_end", f"""{_FR},
n AS (SELECT utt_id, count(*) AS m, count(*) // 2 AS n FROM frames GROUP BY utt_id),
t AS (SELECT utt_id, m, n, unnest(range(0, n)) AS frame FROM n),
p AS (SELECT *, least((frame * m) // (n - 1), m - 1) AS lo,
             CASE WHEN (frame * m) // (n - 1) >= m - 1 THEN 0 ELSE (frame * m) % (n - 1) END AS rem FROM t)
SELECT p.utt_id, p.frame, {r6('a.f0 + p.rem / (p.n - 1)::DOUBLE * (coalesce(b.f0, a.f0) - a.f0)')} AS f0
FROM p JOIN frames a ON a.utt_id = p.utt_id AND a.frame = p.lo
LEFT JOIN frames b ON b.utt_id = p.utt_id AND b.frame = p.lo + 1""")
def resample_clamped(spark, sf):
    rows = _f0(spark, sf)
    want = rows.groupBy("utt_id").agg(F.expr("count(1) div 2").alias("want"))
    out = S.resample_linear(attach(rows, want, "utt_id"), F.col("want"), clamp_end=True)
    return out.withColumn("f0", B.r6(F.col("f0")))


_SEED52 = """
chosen AS (
  SELECT speaker_id FROM pool JOIN pool_pitch USING (speaker_id) WHERE gender = 'f'
  ORDER BY md5('52:' || speaker_id) LIMIT 5),
target AS (
  SELECT tm, sqrt(sum(w * (s * s + (m - tm) * (m - tm))) / sum(w)) AS ts
  FROM (SELECT *, sum(w * m) OVER () / sum(w) OVER () AS tm FROM pool_pitch
        WHERE speaker_id IN (SELECT speaker_id FROM chosen)) GROUP BY tm)"""


def seed_52_target(spark, sf):
    """Pooled log-F0 statistics of the five female pool speakers drawn by seed 52."""
    from framewright.functions import rng
    from framewright.operators import pool as P

    pitch = P.summarize_pitch(B.raw_pitch(spark, sf))
    speakers = B.pool(spark, sf).select("speaker_id", "gender").join(pitch, "speaker_id")
    chosen = P.pool_filter(speakers, gender="f").orderBy(
        rng.hash_key(52, F.col("speaker_id"))).limit(5)
    return P.pool_pitch_stats(chosen, [])


@query("F2_convert_pitch", f"""{_FR}, {B.POOL}, {B.POOL_PITCH}, {_SEED52},
own AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM frames WHERE f0 > 0 GROUP BY utt_id)
SELECT f.utt_id, f.frame, CASE WHEN f.f0 = 0 THEN 0.0 ELSE
  {r4('exp((ln(greatest(f.f0, 1e-9)) - o.m) / greatest(o.s, 1e-8) * t.ts + t.tm)')} END AS f0
FROM frames f JOIN own o USING (utt_id) CROSS JOIN target t""")
def convert(spark, sf):
    target = seed_52_target(spark, sf)
    out = S.convert_pitch(_f0(spark, sf), target.select("mean").scalar(), target.select("std").scalar())
    return out.select("utt_id", "frame", B.r4(F.col("f0")).alias("f0"))


@query("F2_convert_pitch_flat", f"""{_FR}, {B.POOL}, {B.POOL_PITCH}, {_SEED52}
SELECT f.utt_id, f.frame, CASE WHEN f.f0 = 0 THEN 0.0 ELSE {r4('exp(t.tm)')} END AS f0
FROM frames f CROSS JOIN target t""")
def convert_flat(spark, sf):
    target = seed_52_target(spark, sf)
    out = S.convert_pitch(_f0(spark, sf), target.select("mean").scalar(),
                          target.select("std").scalar(), flatten=True)
    return out.select("utt_id", "frame", B.r4(F.col("f0")).alias("f0"))


@query("F3_match_own_pitch", f"""{_FR},
part AS (SELECT utt_id, frame, f0 * 0.5 + frame AS f0 FROM frames WHERE frame % 3 = 0 AND f0 > 0),
src AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM part GROUP BY utt_id),
own AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM frames WHERE f0 > 0 GROUP BY utt_id)
SELECT p.utt_id, p.frame, {r4('exp((ln(p.f0) - s.m) / greatest(s.s, 1e-8) * o.s + o.m)')} AS f0
FROM part p JOIN src s USING (utt_id) JOIN own o USING (utt_id)""")
def match_own(spark, sf):
    rows = _f0(spark, sf)
    part = rows.filter("frame % 3 = 0 and f0 > 0").withColumn("f0", F.col("f0") * 0.5 + F.col("frame"))
    out = S.match_own_pitch(part, rows)
    return out.select("utt_id", "frame", B.r4(F.col("f0")).alias("f0"))


def _smooth_sql(n: int) -> str:
    return f"""{_FR},
v AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY frame) - 1 AS rk,
             least({n}, count(*) OVER (PARTITION BY utt_id)) AS k FROM frames WHERE f0 <> 0),
s AS (SELECT a.utt_id, a.frame, a.f0, sum(b.f0) / any_value(a.k) AS ma
      FROM v a JOIN v b ON a.utt_id = b.utt_id
       AND b.rk BETWEEN a.rk - a.k // 2 AND a.rk + a.k - a.k // 2 - 1
      GROUP BY a.utt_id, a.frame, a.f0)
SELECT utt_id, frame, {r6('0.25 * f0 + 0.75 * ma')} AS f0 FROM s
UNION ALL SELECT utt_id, frame, 0.0 FROM frames WHERE f0 = 0"""


@query("F4_smooth_voiced", _smooth_sql(32))
def smooth(spark, sf):
    return S.smooth_voiced(_f0(spark, sf), 32, 0.75).withColumn("f0", B.r6(F.col("f0")))


@query("F4_smooth_voiced_short_kernel", _smooth_sql(64))
def smooth_short(spark, sf):
    return S.smooth_voiced(_f0(spark, sf), 64, 0.75).withColumn("f0", B.r6(F.col("f0")))


def _noise_sql(divisor: str) -> str:
    noise = sql_normal("'7:' || f.utt_id || ':' || f.frame")
    return f"""{_FR},
p AS (SELECT utt_id, avg(f0 * f0) AS power FROM frames WHERE f0 <> 0 GROUP BY utt_id)
SELECT f.utt_id, f.frame, CASE WHEN f.f0 = 0 THEN 0.0 ELSE
  {r4(f'greatest(f.f0 + sqrt(p.power / {divisor}) * {noise}, 0.0)')} END AS f0
FROM frames f JOIN p USING (utt_id)"""


@query("F5_add_noise", _noise_sql("2.0"))
def noise(spark, sf):
    return S.add_noise(_f0(spark, sf), 2.0, 7).withColumn("f0", B.r4(F.col("f0")))


@query("F5_add_noise_decibel", _noise_sql("pow(10.0, 0.2)"))
def noise_db(spark, sf):
    return S.add_noise(_f0(spark, sf), 2.0, 7, snr_db=True).withColumn("f0", B.r4(F.col("f0")))


_STD = """
g AS (SELECT avg(f0) AS gm, stddev_pop(f0) AS gs FROM frames WHERE f0 <> 0),
k AS (SELECT utt_id, avg(f0) AS mean FROM frames WHERE f0 <> 0 GROUP BY utt_id)"""


@query("F6_standardize_f0", f"""{_FR}, {_STD}
SELECT f.utt_id, f.frame, {r6('(CASE WHEN f.f0 = 0 THEN 0.0 ELSE f.f0 * (100.0 / k.mean) END - g.gm) / g.gs')} AS f0
FROM frames f JOIN k USING (utt_id) CROSS JOIN g""")
def standardize(spark, sf):
    return S.standardize_f0(_f0(spark, sf)).withColumn("f0", B.r6(F.col("f0")))


@query("F7_destandardize_f0", f"""{_FR}
SELECT utt_id, frame, CASE WHEN (f0 - 150) / 60 * 45.0 + 90.0 < 20 THEN 0.0
  ELSE {r6('(f0 - 150) / 60 * 45.0 + 90.0')} END AS f0 FROM frames""")
def destandardize(spark, sf):
    z = _f0(spark, sf).withColumn("f0", (F.col("f0") - 150) / 60)
    return S.destandardize_f0(z, F.lit(90.0), F.lit(45.0)).withColumn("f0", B.r6(F.col("f0")))


@query("F8_normalize_f0", f"""{_FR}
SELECT utt_id, frame, {r6('(f0 - 61.64) / 67.5')} AS f0 FROM frames""")
def normalize_f0(spark, sf):
    return S.normalize_inputs(_f0(spark, sf)).withColumn("f0", B.r6(F.col("f0")))


@query("F8_normalize_xvector", f"""WITH {B.POOL}
SELECT speaker_id, i - 1 AS dim, {r6('xvector[i] / 20.0')} AS x
FROM (SELECT speaker_id, xvector, unnest(range(1, len(xvector) + 1)) AS i FROM pool)""")
def normalize_xvector(spark, sf):
    rows = S.normalize_inputs(B.pool(spark, sf).select("speaker_id", "xvector"))
    return rows.select("speaker_id", F.posexplode("xvector").alias("dim", "x")).select(
        "speaker_id", F.col("dim").cast("bigint").alias("dim"), B.r6(F.col("x")).alias("x"))


@query("F9_bucketize", f"""{_FR}
SELECT utt_id, frame, ({' + '.join(f'(f0 >= {e})::INT' for e in _EDGES)})::BIGINT AS bucket FROM frames""")
def bucketize(spark, sf):
    return _f0(spark, sf).select("utt_id", "frame", S.bucketize(F.col("f0")).cast("bigint").alias("bucket"))


def _ola_sql(chunk: int) -> str:
    step = chunk // 2
    return f"""{_FR},
n AS (SELECT utt_id, count(*) AS n FROM frames GROUP BY utt_id),
c AS (SELECT utt_id, n, unnest(range(0, n, {step})) AS start FROM n WHERE n > {chunk}),
w AS (SELECT f.utt_id, f.frame, f.f0, 0.5 - 0.5 * cos(2 * pi() * (f.frame - c.start) / {chunk - 1}.0) AS w
      FROM frames f JOIN c ON f.utt_id = c.utt_id AND f.frame >= c.start AND f.frame < c.start + {chunk})
SELECT utt_id, frame, {r6('sum(w * f0) / CASE WHEN sum(w) = 0 THEN 1 ELSE sum(w) END')} AS f0
FROM w GROUP BY utt_id, frame
UNION ALL
SELECT utt_id, frame, {r6('f0')} FROM frames JOIN n USING (utt_id) WHERE n <= {chunk}"""


@query("F10_overlap_add", _ola_sql(16))
def ola(spark, sf):
    return S.overlap_add(_f0(spark, sf), 16).withColumn("f0", B.r6(F.col("f0")))


@query("F10_overlap_add_short_series", _ola_sql(64))
def ola_short(spark, sf):
    return S.overlap_add(_f0(spark, sf), 64).withColumn("f0", B.r6(F.col("f0")))


@query("F11_log_compress", f"""{_FR}
SELECT utt_id, frame, {r6('ln(greatest(f0 / 500, 1e-5) * 10.0)')} AS compressed,
  {r6('exp(ln(greatest(f0 / 500, 1e-5) * 10.0)) / 10.0')} AS expanded FROM frames""")
def compress(spark, sf):
    c = S.log_compress(F.col("f0") / 500, 10.0)
    return _f0(spark, sf).select(
        "utt_id", "frame", B.r6(c).alias("compressed"), B.r6(S.log_expand(c, 10.0)).alias("expanded"))


@query("F12_peak_normalize", f"""{_FR}
SELECT utt_id, frame, {r6('f0 / CASE WHEN p > 0 THEN p ELSE 1 END * 0.95')} AS f0
FROM (SELECT *, max(abs(f0)) OVER (PARTITION BY utt_id) AS p FROM frames)""")
def peak(spark, sf):
    return S.peak_normalize(_f0(spark, sf)).withColumn("f0", B.r6(F.col("f0")))


@query("F13_series_sanity", f"""{_FR},
x AS (SELECT utt_id, frame, CASE WHEN utt_id % 11 = 1 THEN 8000 ELSE 16000 END AS rate,
        CASE WHEN utt_id % 7 = 3 AND frame = 3 THEN 'nan'::DOUBLE
             WHEN utt_id % 5 = 0 THEN f0 * 1e-7
             WHEN utt_id % 5 = 1 THEN least(f0 / 150, 1.0) ELSE f0 / 600 END AS sample FROM frames),
a AS (SELECT utt_id, max(rate) AS rate, count(*) AS n,
        sum((isnan(sample))::INT) AS n_bad,
        CASE WHEN bool_or(isnan(sample)) THEN 'nan'::DOUBLE ELSE sqrt(avg(sample * sample)) END AS rms,
        avg((abs(sample) > 0.999)::INT) AS clipped FROM x GROUP BY utt_id),
r AS (SELECT *, n / rate / (n / (CASE WHEN utt_id % 3 = 0 THEN 20000.0 ELSE 16000.0 END)) AS ratio FROM a)
SELECT utt_id, array_to_string(list_filter([
  CASE WHEN rate <> 16000 THEN 'rate:' || rate END,
  CASE WHEN utt_id % 4 = 2 THEN 'channels:2' END,
  CASE WHEN n_bad > 0 THEN 'non_finite' END,
  CASE WHEN rms < 1e-3 THEN 'silent' END,
  CASE WHEN clipped > 0.01 THEN 'clipped' END,
  CASE WHEN NOT (ratio > 0.9 AND ratio < 1.1) THEN 'duration' END], lambda p: p IS NOT NULL), '; ') AS problems
FROM r""")
def sanity(spark, sf):
    rows = _f0(spark, sf)
    sample = (
        F.when((F.col("utt_id") % 7 == 3) & (F.col("frame") == 3), float("nan"))
        .when(F.col("utt_id") % 5 == 0, F.col("f0") * 1e-7)
        .when(F.col("utt_id") % 5 == 1, F.least(F.col("f0") / 150, F.lit(1.0)))
        .otherwise(F.col("f0") / 600))
    x = rows.select("utt_id", "frame", sample.alias("sample"),
                    F.when(F.col("utt_id") % 11 == 1, 8000).otherwise(16000).alias("rate"),
                    F.when(F.col("utt_id") % 4 == 2, 2).otherwise(1).alias("channels"))
    ref = rows.groupBy("utt_id").agg((F.count(F.lit(1)) / F.when(
        F.col("utt_id") % 3 == 0, 20000.0).otherwise(16000.0)).alias("ref_seconds"))
    return S.series_sanity(x, ref, channels="channels").select("utt_id", F.array_join("problems", "; ").alias("problems"))
