"""Registered queries: evaluation (inventory section 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query, r6
from framewright.operators import evaluate as E
from framewright.plans import bindings as B

_NORM = """list_filter(string_split(regexp_replace(replace(lower({0}), '-', ' '), '[^a-z'' ]', ' ', 'g'), ' '), lambda x: x <> '')"""
# Words of a pair become single characters, so that the built-in edit distance counts words.
_WER = f"""WITH {B.PAIRS},
w AS (SELECT item_id, {_NORM.format('ref')} AS r, {_NORM.format('hyp')} AS h FROM pairs),
d AS (SELECT *, list_sort(list_distinct(list_concat(r, h))) AS d FROM w),
e AS (SELECT item_id, len(r)::BIGINT AS n_ref, levenshtein(
    array_to_string(list_transform(r, lambda x: chr((34 + list_position(d, x))::INT)), ''),
    array_to_string(list_transform(h, lambda x: chr((34 + list_position(d, x))::INT)), ''))::BIGINT AS edits FROM d)"""


def pairs(spark, sf):
    return E.wer_pairs(B.wer_pairs_input(spark, sf))


@query("M1_wer_pairs", f"""{_WER} SELECT item_id, edits, n_ref, {r6('edits / greatest(n_ref, 1)::DOUBLE')} AS wer FROM e""")
def wer_pairs(spark, sf):
    return pairs(spark, sf).select("item_id", F.col("edits").cast("bigint").alias("edits"),
                                   F.col("n_ref").cast("bigint").alias("n_ref"), B.r6(F.col("wer")).alias("wer"))


# Dropping words only deletes, so the distance is the difference in length.
@query("M1_wer_pairs_documents", rf"""WITH t AS (SELECT doc_id, text, array_to_string(list_filter(
    list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> ''), lambda x, i: i % 3 <> 0), ' ') AS hyp FROM documents)
SELECT doc_id, len({_NORM.format('text')}) - len({_NORM.format('hyp')}) AS edits, len({_NORM.format('text')}) AS n_ref FROM t""")
def wer_documents(spark, sf):
    """Every document against its text with each third word missing (long texts)."""
    docs = B.table(spark, sf, "documents").repartition(spark.sparkContext.defaultParallelism, "doc_id")
    toks = B.split_words(F.col("text"))
    rows = docs.select("doc_id", F.col("text").alias("ref"), F.array_join(
        F.filter(toks, lambda x, i: (i % 3) != 2), " ").alias("hyp"))
    return E.wer_pairs(rows).select("doc_id", F.col("edits").cast("bigint").alias("edits"),
                                    F.col("n_ref").cast("bigint").alias("n_ref"))


@query("M2_wer_summary", f"""{_WER} SELECT item_id % 4 AS dataset, count(*) AS n,
  {r6('100 * avg(edits / greatest(n_ref, 1)::DOUBLE)')} AS mean_wer, {r6('100 * sum(edits) / sum(n_ref)')} AS corpus_wer
FROM e GROUP BY 1""")
def wer_summary(spark, sf):
    out = E.wer_summary(pairs(spark, sf).withColumn("dataset", F.col("item_id") % 4), ["dataset"])
    return out.select("dataset", "n", B.r6(F.col("mean_wer")).alias("mean_wer"), B.r6(F.col("corpus_wer")).alias("corpus_wer"))


def vector_pairs(spark, sf):
    """utt_id, gender, a, b: each vector with its neighbour stream."""
    a = B.vectors(spark, sf).select("utt_id", "frame", F.col("vec").alias("a"))
    b = B.vectors_b(spark, sf).select("utt_id", "frame", F.col("vec").alias("b"))
    return a.join(b, ["utt_id", "frame"]).withColumn("gender", F.when(F.col("frame") % 2 == 0, "f").otherwise("m"))


_SIM = f"""WITH {B.VECTORS},
s AS (SELECT utt_id, frame, CASE WHEN frame % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
  list_cosine_similarity(a.vec, b.vec) AS sim FROM va a JOIN vb b USING (utt_id, frame))"""


@query("M3_similarity_summary", f"""{_SIM} SELECT utt_id, gender, {r6('avg(sim)')} AS mean_sim, {r6('min(sim)')} AS min_sim, count(*) AS n
FROM s GROUP BY utt_id, gender""")
def similarity_summary(spark, sf):
    out = E.similarity_summary(vector_pairs(spark, sf), ["utt_id", "gender"])
    return out.select("utt_id", "gender", B.r6(F.col("mean_sim")).alias("mean_sim"), B.r6(F.col("min_sim")).alias("min_sim"), "n")


@query("M4_timing_table", f"""WITH {B.TIMINGS},
c AS (SELECT *, count(*) FILTER (NOT cold) OVER (PARTITION BY grp, stage) AS n_warm FROM timings),
w AS (SELECT * FROM c WHERE NOT cold OR n_warm = 0),
a AS (SELECT grp, stage, count(*) AS n, arg_min(seconds, row_id) FILTER (cold) AS cold FROM timings GROUP BY ALL)
SELECT a.grp, a.stage, a.n, any_value({r6('a.cold')}) AS cold, {r6('avg(seconds)')} AS warm_mean, {r6('quantile_cont(seconds, 0.5)')} AS warm_median,
  {r6('quantile_cont(seconds, 0.95)')} AS warm_p95, {r6('max(seconds)')} AS warm_max,
  CASE WHEN count(audio_seconds) = count(*) THEN {r6('sum(seconds) / sum(audio_seconds)')} END AS warm_rtf
FROM a JOIN w USING (grp, stage) GROUP BY a.grp, a.stage, a.n""")
def timing_table(spark, sf):
    out = E.timing_table(B.timings(spark, sf))
    return out.select("grp", "stage", "n", *[B.r6(F.col(c)).alias(c) for c in (
        "cold", "warm_mean", "warm_median", "warm_p95", "warm_max", "warm_rtf")])


@query("M4_timing_table_by_file", f"""WITH {B.TIMINGS}
SELECT 'file ' || file AS grp, stage, count(*) AS n, {r6('quantile_cont(seconds, 0.5)')} AS warm_median,
  {r6('quantile_cont(seconds, 0.95)')} AS warm_p95,
  CASE WHEN count(audio_seconds) = count(*) THEN {r6('sum(seconds) / sum(audio_seconds)')} END AS warm_rtf
FROM timings GROUP BY file, stage""")
def timing_by_file(spark, sf):
    rows = B.timings(spark, sf).withColumn("grp", F.concat(F.lit("file "), F.col("file").cast("string")))
    out = E.timing_table(rows)
    return out.select("grp", "stage", "n", *[B.r6(F.col(c)).alias(c) for c in ("warm_median", "warm_p95", "warm_rtf")])


@query("M5_audio_summary", f"""WITH {B.TIMINGS} SELECT count(*) AS n, min(audio_seconds) AS shortest, max(audio_seconds) AS longest,
  {r6('avg(audio_seconds)')} AS mean FROM (SELECT DISTINCT file, audio_seconds FROM timings WHERE audio_seconds > 0)""")
def audio_summary(spark, sf):
    return E.audio_summary(B.timings(spark, sf)).withColumn("mean", B.r6(F.col("mean")))


@query("M6_cost_table", f"""WITH {B.TIMINGS},
t AS (SELECT 'beta' || (file % 3) AS setting, sum(seconds) / sum(audio_seconds) AS rtf FROM timings
      WHERE NOT cold AND audio_seconds > 0 AND grp = 'end to end' GROUP BY file % 3)
SELECT setting, {r6('rtf')} AS rtf, {r6('1 / rtf')} AS audio_hours_per_hour, {r6('0.55 * rtf')} AS cost_per_hour,
  {r6('1000 * 0.55 * rtf')} AS cost_per_1000_hours FROM t""")
def cost_table(spark, sf):
    rows = B.timings(spark, sf).withColumn("stage", F.lit("TOTAL")).withColumn(
        "grp", F.concat("grp", F.lit(" beta"), (F.col("file") % 3).cast("string")))
    prices = {"vm_usd_per_hour": 0.2, "gpu_usd_per_hour": 0.35, "platform_usd_per_hour": 0.0, "source": 9.0}
    out = E.cost_table(rows, prices)
    return out.select("setting", *[B.r6(F.col(c)).alias(c) for c in out.columns if c != "setting"])


RULES = [("mean_sim", None, 0.05, "FAIL"), ("min_sim", -0.3, None, "WARN")]


def checks(spark, sf):
    sims = E.similarity_summary(vector_pairs(spark, sf), ["utt_id"])
    metrics = sims.select(
        F.concat(F.lit("recording "), F.col("utt_id").cast("string")).alias("check"),
        F.explode(F.create_map(F.lit("mean_sim"), F.col("mean_sim"), F.lit("min_sim"), F.col("min_sim"))).alias("metric", "value"))
    rules = spark.createDataFrame(RULES, "metric string, low double, high double, otherwise string")
    return E.evaluate_checks(metrics, rules)


_CHECKS = f"""{_SIM}, m AS (SELECT utt_id, avg(sim) AS mean_sim, min(sim) AS min_sim FROM s GROUP BY utt_id),
k AS (SELECT 'recording ' || utt_id AS "check", 'mean_sim' AS metric, CASE WHEN mean_sim < 0.05 THEN 'PASS' ELSE 'FAIL' END AS status,
        printf('mean_sim=%.3f', mean_sim) AS detail FROM m
      UNION ALL SELECT 'recording ' || utt_id, 'min_sim', CASE WHEN min_sim > -0.3 THEN 'PASS' ELSE 'WARN' END,
        printf('min_sim=%.3f', min_sim) FROM m)"""


@query("M7_evaluate_checks", f"{_CHECKS} SELECT * FROM k")
def evaluate_checks(spark, sf):
    return checks(spark, sf).select("check", "metric", "status", "detail")


@query("M7_status_totals", f"{_CHECKS} SELECT status, count(*) AS n FROM k GROUP BY status")
def status_totals(spark, sf):
    return E.status_totals(checks(spark, sf))


@query("M8_sweep_best", f"""{_SIM}, t AS (SELECT utt_id AS criterion, gender, {r6('round(avg(sim), 3)')} AS mean_sim,
  {r6('round(min(sim), 3)')} AS min_sim FROM s GROUP BY utt_id, gender)
SELECT *, row_number() OVER (ORDER BY mean_sim DESC, criterion, gender) - 1 AS rank FROM t""")
def sweep_best(spark, sf):
    scores = vector_pairs(spark, sf).select(
        F.col("utt_id").alias("criterion"), "gender", E.cosine(F.col("a"), F.col("b")).alias("similarity"))
    out = E.sweep_best(scores, ["criterion", "gender"])
    return out.select("criterion", "gender", B.r6(F.col("mean_sim")).alias("mean_sim"), B.r6(F.col("min_sim")).alias("min_sim"), "rank")


@query("M9_first_k_per_group", """WITH o AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)
SELECT lang, source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM o WHERE r = 1) WHERE k <= 2""")
def first_k(spark, sf):
    docs = B.table(spark, sf, "documents").select("lang", "source", "doc_id")
    return E.first_k_per_group(docs, "lang", "source", "doc_id", 2)


@query("M10_stage_shares", f"""WITH {B.TIMINGS}
SELECT CASE WHEN stage IN ('view', 'click') THEN 'browse' ELSE stage END AS stage, {r6('sum(seconds)')} AS seconds,
  {r6('sum(seconds) / (SELECT sum(seconds) FROM timings)')} AS share FROM timings GROUP BY 1""")
def stage_shares(spark, sf):
    out = E.stage_shares(B.timings(spark, sf), {"view": "browse", "click": "browse"})
    return out.select("stage", B.r6(F.col("seconds")).alias("seconds"), B.r6(F.col("share")).alias("share"))


def _twice_sql(other: str) -> str:
    return f"""WITH a AS (SELECT vec_id, md5('52:' || vec_id) AS draw FROM embeddings), b AS (SELECT vec_id, md5('{other}:' || vec_id) AS draw FROM embeddings)
, n AS (SELECT (SELECT count(*) FROM (FROM a EXCEPT ALL FROM b)) AS only_a, (SELECT count(*) FROM (FROM b EXCEPT ALL FROM a)) AS only_b)
SELECT only_a, only_b, only_a + only_b = 0 AND (SELECT count(*) FROM a JOIN b USING (vec_id, draw)) = (SELECT count(*) FROM a) AS same FROM n"""


def _twice(spark, sf, other):
    from framewright.functions import rng

    vecs = B.table(spark, sf, "embeddings")

    def draw(seed):
        return vecs.select("vec_id", rng.hash_key(seed, F.col("vec_id")).alias("draw"))

    return E.same_output(draw(52), draw(other).repartition(3))


@query("M11_same_output", _twice_sql("52"))
def same_output(spark, sf):
    return _twice(spark, sf, 52)


@query("M11_other_output", _twice_sql("53"))
def other_output(spark, sf):
    return _twice(spark, sf, 53)


@query("M12_mean_l1", f"""WITH {B.FRAMES}, {B.SECOND_F0}
SELECT a.utt_id, {r6('avg(abs(a.f0 - b.f0))')} AS l1 FROM frames a JOIN second_f0 b USING (utt_id, frame) GROUP BY a.utt_id""")
def mean_l1(spark, sf):
    out = E.mean_l1(B.frames(spark, sf), B.second_f0(spark, sf))
    return out.select("utt_id", B.r6(F.col("l1")).alias("l1"))


@query("M13_pool_report", f"""WITH {B.POOL} SELECT cluster, count(*) AS n, min(len(xvector)) AS min_dim, max(len(xvector)) AS max_dim,
  count(*) FILTER (gender = 'f') AS n_f, count(*) FILTER (gender = 'm') AS n_m FROM pool GROUP BY cluster""")
def pool_report(spark, sf):
    out = E.pool_report(B.pool(spark, sf))
    return out.withColumn("min_dim", F.col("min_dim").cast("bigint")).withColumn("max_dim", F.col("max_dim").cast("bigint"))
