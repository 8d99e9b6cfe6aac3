"""Registered queries: speaker pool (inventory section 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.mixing import digest, sql_digest
from framewright.catalog.registry import query, r6, sql_uniform
from framewright.operators import pool as P
from framewright.operators.scans import attach
from framewright.plans import bindings as B


def requests(spark, sf):
    """seed, gender: one seed per user, both genders and an open one."""
    seeds = B.table(spark, sf, "events").select(F.col("user_id").alias("seed")).distinct()
    return seeds.withColumn("gender", F.explode(F.array(F.lit("f"), F.lit("m"), F.lit("any"))))


def _pitch(spark, sf):
    return P.summarize_pitch(B.raw_pitch(spark, sf))


_REQ = f"""req AS (
  SELECT seed, g AS asked, CASE WHEN g <> 'any' THEN g
    WHEN {sql_uniform("seed || ':gender'")} < 0.5 THEN 'f' ELSE 'm' END AS gender
  FROM (SELECT DISTINCT user_id AS seed FROM events) CROSS JOIN (SELECT unnest(['f', 'm', 'any']) AS g))"""
_KNOWN = """known AS (SELECT p.*, q.m, q.s, q.w FROM pool p JOIN pool_pitch q USING (speaker_id))"""


def sql_two(group: str, source: str, requested: str = "req") -> str:
    """Two distinct seeded indices of each request's group, as ``chosen(seed, asked, speaker_id)``."""
    first = sql_uniform("seed || ':draw:' || (size - 2)")
    second = sql_uniform("seed || ':draw:' || (size - 1)")
    return f"""ids AS (
  SELECT speaker_id, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY ord) - 1 AS idx,
         count(*) OVER (PARTITION BY {group}) AS size FROM {source}),
drawn AS (
  SELECT r.*, z.size, CASE WHEN size > 1 THEN floor({first} * (size - 1))::BIGINT END AS i1,
         floor({second} * size)::BIGINT AS i2
  FROM {requested} r JOIN (SELECT DISTINCT grp, size FROM ids) z ON z.grp = r.{group}),
chosen AS (
  SELECT d.seed, d.asked, d.gender AS asked_gender, i.speaker_id FROM drawn d JOIN ids i ON i.grp = d.{group}
   AND (i.idx = d.i1 OR i.idx = CASE WHEN d.i2 = d.i1 THEN d.size - 1 ELSE d.i2 END))"""


@query("K1_pool_filter", f"""WITH {B.POOL}
SELECT speaker_id, cluster FROM pool WHERE gender = 'f' AND cluster = 3""")
def pool_filter(spark, sf):
    return P.pool_filter(B.pool(spark, sf), "f", 3).select("speaker_id", "cluster")


@query("K2_cluster_gender", f"""WITH {B.POOL}, {B.CLUSTERS}
SELECT c.cluster, c.centre_speaker, c.density_pos, p.gender,
       count(*) OVER (PARTITION BY p.gender) AS n_clusters
FROM clusters c JOIN pool p ON p.speaker_id = c.centre_speaker""")
def cluster_gender(spark, sf):
    located = P.cluster_gender(B.pool(spark, sf), B.clusters(spark, sf))
    return located.join(P.genders_of_clusters(located), "gender").select(
        "cluster", "centre_speaker", "density_pos", "gender", "n_clusters")


def _short_sql(criterion: str, top_n: int) -> str:
    order = "ASC" if criterion == P.SPARSE else "DESC"
    return f"""located AS (SELECT c.*, p.gender FROM clusters c JOIN pool p ON p.speaker_id = c.centre_speaker),
short AS (
  SELECT *, row_number() OVER (PARTITION BY gender ORDER BY density_pos) - 1 AS pick,
         count(*) OVER (PARTITION BY gender) AS n_picks FROM (
    SELECT *, row_number() OVER (PARTITION BY gender ORDER BY density_pos {order}) AS rk FROM located)
  WHERE rk <= {top_n}),
placed AS (
  SELECT r.seed, r.asked, r.gender, s.cluster FROM req r JOIN short s ON s.gender = r.gender
   AND s.pick = floor({sql_uniform("r.seed || ':cluster'")} * s.n_picks))"""


def _choose(criterion):
    @query(f"K3_choose_{criterion}", f"""WITH {B.POOL}, {B.CLUSTERS}, {_REQ}, {_short_sql(criterion, 3)}
SELECT seed, gender, cluster FROM placed WHERE asked <> 'any'""")
    def choose(spark, sf):
        located = P.cluster_gender(B.pool(spark, sf), B.clusters(spark, sf))
        asked = requests(spark, sf).filter("gender <> 'any'")
        return P.choose_cluster(asked, located, criterion, 3).select("seed", "gender", "cluster")


_choose(P.SPARSE)
_choose(P.DENSE)


@query("K4_sample_count", f"""WITH {B.POOL}, {_REQ}, {sql_two('gender', 'pool')}
SELECT seed, asked_gender AS gender, speaker_id FROM chosen WHERE asked <> 'any'""")
def sample_count(spark, sf):
    asked = requests(spark, sf).filter("gender <> 'any'")
    return P.sample_speakers(asked, B.pool(spark, sf), 2).select("seed", "gender", "speaker_id")


def sql_share(group: str, source: str, share: float, requested: str = "req") -> str:
    """A seeded share of each request's group, as ``chosen(seed, asked, asked_gender, speaker_id)``."""

    def mixed(x: str, a: str, b: str) -> str:
        return f"(({x} * ({a} * 2 + 1) + {b}) & mask)"

    numbers = ", ".join(f"floor({sql_uniform(f"seed || ':share:{c}'")} * 1073741824)::BIGINT AS n{c}" for c in "abcd")
    rounds = f"""SELECT * REPLACE (xor(y, y >> half) AS x) FROM (SELECT *, {mixed('x', 'nc', 'nd')} AS y FROM (
      SELECT * EXCLUDE (y) REPLACE (xor(y, y >> half) AS x) FROM (SELECT *, {mixed('x', 'na', 'nb')} AS y FROM {{0}})))"""
    step = "SELECT seed, asked, grp, asked_gender, size, mask, half, na, nb, nc, nd, j, x FROM (" + rounds + ")"
    return f"""ids AS (
  SELECT speaker_id, {group} AS grp, row_number() OVER (PARTITION BY {group} ORDER BY ord) - 1 AS idx,
         count(*) OVER (PARTITION BY {group}) AS size FROM {source}),
groups AS (SELECT DISTINCT grp, size, length(bin(greatest(size - 1, 1)))::INT AS bits FROM ids),
starts AS (
  SELECT r.seed, r.asked, g.grp, r.gender AS asked_gender, g.size, (1::BIGINT << bits) - 1 AS mask, (bits + 1) // 2 AS half, {numbers},
         unnest(range(0, greatest(floor(g.size * {share})::BIGINT, 1))) AS j
  FROM {requested} r JOIN groups g ON g.grp = r.{group}),
first AS ({step.format("(SELECT *, j AS x FROM starts)")}),
walk AS (SELECT * FROM first UNION ALL {step.format("(SELECT * FROM walk WHERE x >= size)")}),
chosen AS (SELECT w.seed, w.asked, w.asked_gender, i.speaker_id FROM walk w JOIN ids i ON i.grp = w.grp AND i.idx = w.x WHERE w.x < w.size)"""


@query("K4_sample_proportion", f"""WITH RECURSIVE {B.POOL}, {_REQ}, {sql_share('gender', 'pool', 0.05)}
SELECT seed, asked_gender AS gender, speaker_id FROM chosen WHERE asked <> 'any'""")
def sample_proportion(spark, sf):
    asked = requests(spark, sf).filter("gender <> 'any'")
    return P.sample_speakers(asked, B.pool(spark, sf), 0.05).select("seed", "gender", "speaker_id")


@query("K5_draw_gender", f"""SELECT DISTINCT user_id AS seed,
  CASE WHEN {sql_uniform("user_id || ':gender'")} < 0.5 THEN 'f' ELSE 'm' END AS gender FROM events""")
def draw_gender(spark, sf):
    seeds = B.table(spark, sf, "events").select(F.col("user_id").alias("seed")).distinct()
    return seeds.select("seed", P.draw_gender(F.col("seed")).alias("gender"))


@query("K6_average_xvector", f"""WITH {B.POOL}
SELECT cluster, gender, i - 1 AS dim, {r6('avg(xvector[i])')} AS x
FROM (SELECT *, unnest(range(1, 65)) AS i FROM pool) GROUP BY cluster, gender, i""")
def average(spark, sf):
    out = P.average_xvector(B.pool(spark, sf), ["cluster", "gender"])
    return out.select("cluster", "gender", F.posexplode("xvector").alias("dim", "x")).select(
        "cluster", "gender", F.col("dim").cast("bigint").alias("dim"), B.r6(F.col("x")).alias("x"))


@query("K7_majority_gender", f"""WITH {B.POOL}
SELECT cluster, CASE WHEN count(*) FILTER (gender = 'f') >= count(*) FILTER (gender = 'm')
  THEN 'f' ELSE 'm' END AS gender FROM pool GROUP BY cluster""")
def majority(spark, sf):
    return P.majority_gender(B.pool(spark, sf), ["cluster"])


_POOLED = """{mean} AS mean, sqrt(sum(w * (s * s + (m - mu) * (m - mu))) / sum(w)) AS std"""


@query("K8_pool_pitch_stats", f"""WITH {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN},
c AS (SELECT *, sum(w * m) OVER (PARTITION BY cluster) / sum(w) OVER (PARTITION BY cluster) AS mu FROM known)
SELECT cluster, {r6('any_value(mu)')} AS mean, {r6('sqrt(sum(w * (s * s + (m - mu) * (m - mu))) / sum(w))')} AS std
FROM c GROUP BY cluster""")
def pooled_pitch(spark, sf):
    known = B.pool(spark, sf).join(_pitch(spark, sf), "speaker_id")
    out = P.pool_pitch_stats(known, ["cluster"])
    return out.select("cluster", B.r6(F.col("mean")).alias("mean"), B.r6(F.col("std")).alias("std"))


@query("K9_raw_pitch_stats", f"""WITH {B.FRAMES}, {B.POOL}
SELECT p.cluster, {r6('avg(ln(f0))')} AS mean, {r6('stddev_pop(ln(f0))')} AS std
FROM frames f JOIN pool p ON p.speaker_id = f.utt_id WHERE f0 > 0 GROUP BY p.cluster""")
def raw_stats(spark, sf):
    series = attach(B.raw_pitch(spark, sf), B.pool(spark, sf).select("speaker_id", "cluster"), "speaker_id", pos="idx")
    out = P.raw_pitch_stats(series, ["cluster"])
    return out.select("cluster", B.r6(F.col("mean")).alias("mean"), B.r6(F.col("std")).alias("std"))


@query("K10_summarize_pitch", f"""WITH {B.FRAMES}, {B.POOL_PITCH}
SELECT speaker_id, {r6('m')} AS m, {r6('s')} AS s, w FROM pool_pitch""")
def summarize(spark, sf):
    return _pitch(spark, sf).select("speaker_id", B.r6(F.col("m")).alias("m"), B.r6(F.col("s")).alias("s"), "w")


_PSEUDO = f"""sel AS (SELECT c.*, k.gender, k.xvector, k.m, k.s, k.w FROM chosen c JOIN known k USING (speaker_id)),
stat AS (
  SELECT seed, asked, any_value(asked_gender) AS asked_gender,
    CASE WHEN count(*) FILTER (gender = 'f') >= count(*) FILTER (gender = 'm') THEN 'f' ELSE 'm' END AS gender,
    sum(w * m) / sum(w) AS mean, string_agg(speaker_id, ':' ORDER BY speaker_id) AS selected
  FROM sel GROUP BY seed, asked),
dev AS (SELECT s.seed, s.asked, sqrt(sum(w * (s.s * s.s + (s.m - t.mean) * (s.m - t.mean))) / sum(w)) AS std
  FROM sel s JOIN stat t USING (seed, asked) GROUP BY s.seed, s.asked),
vecs AS (SELECT seed, asked, list(x ORDER BY i) AS xvector FROM (
  SELECT seed, asked, i, avg(xvector[i]) AS x FROM (SELECT *, unnest(range(1, 65)) AS i FROM sel)
  GROUP BY seed, asked, i) GROUP BY seed, asked)"""
_PSEUDO_OUT = f"""SELECT seed, asked_gender, gender, {r6('mean')} AS mean, {r6('std')} AS std, selected,
  {sql_digest('xvector')} FROM stat JOIN dev USING (seed, asked) JOIN vecs USING (seed, asked)"""


def pseudospeakers(spark, sf, criterion=None, asked=None, n_speakers=2):
    pool = B.pool(spark, sf)
    located = P.cluster_gender(pool, B.clusters(spark, sf)) if criterion else None
    if asked is None:
        asked = requests(spark, sf).withColumn("asked", F.col("gender"))
    return P.generate_pseudospeakers(asked, pool, _pitch(spark, sf), n_speakers, criterion, located, 3)


def _show(out):
    return out.select(
        "seed", "asked_gender", "gender", B.r6(F.col("mean")).alias("mean"), B.r6(F.col("std")).alias("std"),
        F.array_join(F.transform("selected", lambda x: x.cast("string")), ":").alias("selected"),
        *digest(F.col("xvector")))


@query("K11_generate_pseudospeakers", f"""WITH {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN}, {_REQ},
{sql_two('gender', 'known')}, {_PSEUDO} {_PSEUDO_OUT}""")
def generate(spark, sf):
    return _show(pseudospeakers(spark, sf))


@query("K11_generate_pseudospeakers_half_the_pool", f"""WITH RECURSIVE {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN}, {_REQ},
{sql_share('gender', 'known', 0.5)}, {_PSEUDO} {_PSEUDO_OUT}""")
def generate_half(spark, sf):
    return _show(pseudospeakers(spark, sf, n_speakers=0.5))


@query("K11_generate_pseudospeakers_sparse", f"""WITH {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN}, {_REQ},
{B.CLUSTERS}, {_short_sql(P.SPARSE, 3)}, {sql_two('cluster', 'known', 'placed')}, {_PSEUDO} {_PSEUDO_OUT}""")
def generate_sparse(spark, sf):
    return _show(pseudospeakers(spark, sf, P.SPARSE))


@query("K12_pseudospeaker_json_round_trip", f"""WITH {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN}, {_REQ},
{sql_two('gender', 'known')}, {_PSEUDO} {_PSEUDO_OUT}""")
def json_round_trip(spark, sf):
    texts = P.pseudospeaker_to_json(pseudospeakers(spark, sf)).select("seed", "asked_gender", "json")
    back = texts.withColumn("p", P.pseudospeaker_from_json(F.col("json"))).select(
        "seed", "asked_gender", "p.gender", "p.xvector", "p.pitch_stats.mean", "p.pitch_stats.std",
        F.split("p.selected_speakers", ":").alias("selected"))
    return _show(back)


@query("K13_compare_strategies", f"""WITH {B.POOL}, {B.CLUSTERS}, {_REQ}, {_short_sql(P.SPARSE, 3)},
dense AS (
  SELECT *, row_number() OVER (PARTITION BY gender ORDER BY density_pos) - 1 AS pick FROM (
    SELECT *, row_number() OVER (PARTITION BY gender ORDER BY density_pos DESC) AS rk FROM located) WHERE rk <= 3),
other AS (
  SELECT r.seed, r.asked, r.gender, s.cluster FROM req r JOIN dense s ON s.gender = r.gender
   AND s.pick = floor({sql_uniform("r.seed || ':cluster'")} * 3))
SELECT a.gender AS asked_gender, count(*) AS n, count(*) FILTER (a.cluster = b.cluster) AS n_same
FROM placed a JOIN other b USING (seed, asked) WHERE a.asked <> 'any'
  AND EXISTS (SELECT 1 FROM pool p JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = p.speaker_id WHERE p.cluster = a.cluster)
  AND EXISTS (SELECT 1 FROM pool p JOIN (SELECT DISTINCT user_id FROM events) e ON e.user_id = p.speaker_id WHERE p.cluster = b.cluster)
GROUP BY a.gender""")
def compare(spark, sf):
    asked = requests(spark, sf).filter("gender <> 'any'")
    out = P.compare_strategies(pseudospeakers(spark, sf, P.SPARSE, asked), pseudospeakers(spark, sf, P.DENSE, asked))
    return out.groupBy("asked_gender").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same"))
