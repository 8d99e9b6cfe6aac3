"""Registered queries: workflows, hooks and streams (inventory sections 2.11 and 2.12)."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewright.catalog.editing import base_frames
from framewright.catalog.evaluate import _SIM, _WER, pairs, vector_pairs
from framewright.catalog.mixing import _SHIFTED, _VSUM, _shifted_codes, digest, sql_digest, sql_unit
from framewright.catalog.pool import _KNOWN, _PSEUDO, _pitch, sql_two
from framewright.catalog.registry import query, r4, r6, sql_normal, sql_uniform
from framewright.functions.vectors import cosine
from framewright.operators import corpus as C
from framewright.operators import hooks as H
from framewright.plans import bindings as B
from framewright.plans import workflows as X
from framewright.session import materialize, scratch_dir
from framewright.streaming import incremental as ST


def _utts(spark, sf):
    return B.manifest(spark, sf).select(F.col("doc_id").alias("utt_id"), "path")


_GRID = f"""grid AS (
  SELECT doc_id AS utt_id, path, 'pseudo' AS speaker_mode, seed, NULL::VARCHAR AS gender, ratio,
         doc_id || '_seed' || seed || '_rand_' || replace(printf('adm%.3f', ratio), '.', 'p') AS result
  FROM manifest CROSS JOIN (SELECT unnest([52, 53]) AS seed) CROSS JOIN (SELECT unnest([0.3, 0.7]::DOUBLE[]) AS ratio)
  UNION ALL
  SELECT doc_id, path, 'original', NULL, NULL, ratio, 'anonymized_' || doc_id || '_original_' || replace(printf('adm%.3f', ratio), '.', 'p')
  FROM manifest CROSS JOIN (SELECT unnest([0.3, 0.7]::DOUBLE[]) AS ratio))"""


def _grid(spark, sf):
    return X.work_grid(_utts(spark, sf), X.parse_list(" 52,53, "), X.parse_list("0.3, 0.7", float, [0.5]),
                       "any", include_original=True)


@query("P1_work_grid", f"WITH {B.MANIFEST}, {_GRID} SELECT * REPLACE (coalesce(seed, -1) AS seed) FROM grid")
def work_grid(spark, sf):
    return _grid(spark, sf).fillna(-1, ["seed"])


@query("P1_work_grid_fresh_seeds", f"""WITH {B.MANIFEST}, s AS (
  SELECT doc_id AS utt_id, floor({sql_uniform("'3:' || path || ':seed'")} * 1000000)::BIGINT AS seed FROM manifest)
SELECT utt_id, seed, utt_id || '_seed' || seed || '_m_adm0p500' AS result FROM s""")
def work_grid_fresh(spark, sf):
    grid = X.work_grid(_utts(spark, sf), X.parse_list(""), X.parse_list("", float, [0.5]), "m", base_seed=3)
    return grid.select("utt_id", "seed", "result")


def _pending(spark, sf):
    grid = _grid(spark, sf)
    results = grid.filter("utt_id % 3 = 0").select(
        "result", F.when(F.col("utt_id") % 2 == 0, 100).otherwise(0).alias("n_bytes"))
    return X.pending_work(grid, results)


@query("P2_pending_work", f"WITH {B.MANIFEST}, {_GRID} SELECT utt_id, result FROM grid WHERE NOT (utt_id % 6 = 0)")
def pending(spark, sf):
    return _pending(spark, sf)[0].select("utt_id", "result")


@query("P2_skipped_work", f"""WITH {B.MANIFEST}, {_GRID}
SELECT utt_id, result, 'skipped' AS status, NULL::VARCHAR AS sample_rate FROM grid WHERE utt_id % 6 = 0""")
def skipped(spark, sf):
    out = _pending(spark, sf)[1]
    return out.withColumn("sample_rate", F.col("sample_rate").cast("string"))


def _anonymized(spark, sf, gate=False, noise=0.0):
    syn, orig = _shifted_codes(spark, sf)

    def vec(df):
        return df.select("utt_id", "frame", F.transform("codes", lambda c: c.cast("double")).alias("vec"))

    frames = B.frames(spark, sf).select("utt_id", "frame", "f0")
    utts = frames.select("utt_id").distinct().withColumn("path", F.concat(F.col("utt_id").cast("string"), F.lit(".wav")))
    grid = X.work_grid(utts, [52, 53], [0.3, 0.7], include_original=True)
    own = utts.select("utt_id", F.array(F.col("utt_id").cast("double"), F.lit(1.0)).alias("xvector"))
    return X.anonymize(frames, vec(orig), vec(syn), B.pool(spark, sf), _pitch(spark, sf), grid, own, gate=gate, noise=noise)


_ANON = f"""WITH {B.FRAMES}, {B.CODES_SQL}, {_SHIFTED}, {B.POOL}, {B.POOL_PITCH}, {_KNOWN},
req AS (SELECT seed, 'any' AS asked, CASE WHEN {sql_uniform("seed || ':gender'")} < 0.5 THEN 'f' ELSE 'm' END AS gender
        FROM (SELECT unnest([52, 53]) AS seed)),
{sql_two('gender', 'known')}, {_PSEUDO},
own AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM frames WHERE f0 > 0 GROUP BY utt_id),
conv AS (SELECT f.utt_id, t.seed, f.frame, exp((ln(f.f0) - o.m) / greatest(o.s, 1e-8) * d.std + t.mean) AS f0,
           row_number() OVER (PARTITION BY f.utt_id, t.seed ORDER BY f.frame) AS rk
         FROM frames f JOIN own o USING (utt_id) CROSS JOIN stat t JOIN dev d USING (seed, asked) WHERE f.f0 > 0),
ma AS (SELECT a.utt_id, a.seed, a.frame, 0.25 * any_value(a.f0) + 0.75 * sum(b.f0) / 32 AS f0
       FROM conv a JOIN conv b ON a.utt_id = b.utt_id AND a.seed = b.seed AND b.rk BETWEEN a.rk - 16 AND a.rk + 15
       GROUP BY a.utt_id, a.seed, a.frame),
ratios AS (SELECT unnest([0.3, 0.7]::DOUBLE[]) AS ratio),
settings AS (SELECT seed, ratio, 'seed' || seed || '_rand_' || replace(printf('adm%.3f', ratio), '.', 'p') AS tail
  FROM ratios CROSS JOIN (SELECT unnest([52, 53]) AS seed)
  UNION ALL SELECT NULL, ratio, 'original_' || replace(printf('adm%.3f', ratio), '.', 'p') FROM ratios)"""


_FRAME_RESULT = "CASE WHEN s.seed IS NULL THEN 'anonymized_' ELSE '' END || f.utt_id || '_' || s.tail AS result"
_DRAWN = sql_uniform("coalesce(s.seed, 0) || ':' || f.utt_id || ':' || f.frame") + " > s.ratio"
_ANON_FRAMES = f"""{_ANON}
SELECT f.utt_id, {_FRAME_RESULT}, f.frame,
  {r4('CASE WHEN s.seed IS NULL THEN f.f0 WHEN f.f0 = 0 THEN 0.0 ELSE ma.f0 END')} AS f0,
  {sql_digest(f'''(CASE WHEN {_DRAWN} THEN [o.c0, o.c1, o.c2, o.c3] ELSE [y.c0, y.c1, y.c2, y.c3] END)''')}
FROM frames f CROSS JOIN settings s JOIN orig o USING (utt_id, frame) JOIN syn y USING (utt_id, frame)
LEFT JOIN ma ON ma.utt_id = f.utt_id AND ma.frame = f.frame AND ma.seed = s.seed"""


@query("P3_anonymize", _ANON_FRAMES)
def anonymize(spark, sf):
    out, _ = _anonymized(spark, sf)
    return out.select("utt_id", "result", "frame", B.r4(F.col("f0")).alias("f0"), *digest(F.col("vec")))


_HEAD, _TUNED = _ANON.split("\nown AS (")
_PIECES = [(0, 5, 25, 15), (1, 40, 60, 30)]  # seg, range, length of the generated piece


def _overlaid(q: int) -> str:
    inside = " OR ".join(f"frame BETWEEN {a} AND {min(b, a + n) - 1}" for _, a, b, n in _PIECES)
    return f"CASE WHEN {inside} THEN s.c{q} ELSE o.c{q} END AS c{q}"


def _decoded(name: str, source: str) -> str:
    books = " ".join(f"JOIN codebook b{q} ON b{q}.q = {q} AND b{q}.code = c.c{q}" for q in range(B.LEVELS))
    return f"{name} AS (SELECT c.utt_id, c.frame, {_VSUM} AS vec FROM {source} c {books})"


@query("P3_anonymize_recordings", f"""{_HEAD} {B.CODEBOOK},
raw AS (SELECT utt_id, frame // 2 AS frame, f0 FROM frames WHERE frame % 2 = 0),
n AS (SELECT utt_id, count(*) AS n, (count(*) + 1) // 2 AS m FROM frames GROUP BY utt_id),
spot AS (SELECT utt_id, n, frame, (frame * (m - 1)) // (n - 1) AS lo, (frame * (m - 1)) % (n - 1) AS rem
  FROM (SELECT *, unnest(range(0, n)) AS frame FROM n)),
pitch AS (SELECT t.utt_id, t.frame, a.f0 + t.rem / (t.n - 1)::DOUBLE * (coalesce(b.f0, a.f0) - a.f0) AS f0 FROM spot t
  JOIN raw a ON a.utt_id = t.utt_id AND a.frame = t.lo LEFT JOIN raw b ON b.utt_id = t.utt_id AND b.frame = t.lo + 1),
laid AS (SELECT o.utt_id, frame, {', '.join(_overlaid(q) for q in range(B.LEVELS))} FROM orig o JOIN syn s USING (utt_id, frame)),
hurt AS (SELECT utt_id, bool_or(c0 = 1024) AS hit, {', '.join(f'bool_or(c{q} IN (1024, -1)) AS h{q}' for q in range(B.LEVELS))} FROM laid GROUP BY utt_id),
mended AS (SELECT l.utt_id, l.frame, {', '.join(f'CASE WHEN hit AND h{q} THEN o.c{q} ELSE l.c{q} END AS c{q}' for q in range(B.LEVELS))}
  FROM laid l JOIN orig o USING (utt_id, frame) JOIN hurt USING (utt_id)),
{_decoded('vo', 'orig')}, {_decoded('vs', 'mended')},
own AS ({_TUNED.replace('frames', 'pitch')},
v AS (SELECT seed, xvector FROM stat JOIN vecs USING (seed, asked))
SELECT f.utt_id, {_FRAME_RESULT}, f.frame, {sql_digest(f'''list_concat(CASE WHEN {_DRAWN} THEN o.vec ELSE y.vec END,
  [round(CASE WHEN s.seed IS NULL THEN f.f0 WHEN f.f0 = 0 THEN 0.0 ELSE ma.f0 END, 3)], CASE WHEN s.seed IS NULL THEN [f.utt_id::DOUBLE, 1.0] ELSE v.xvector END)''')}
FROM pitch f CROSS JOIN settings s JOIN vo o USING (utt_id, frame) JOIN vs y USING (utt_id, frame)
LEFT JOIN v ON v.seed = s.seed LEFT JOIN ma ON ma.utt_id = f.utt_id AND ma.frame = f.frame AND ma.seed = s.seed""")
def anonymize_recordings(spark, sf):
    """Half-rate pitch, two generated pieces per recording, one shorter and one longer than its range."""
    syn, orig = _shifted_codes(spark, sf)
    raw = B.frames(spark, sf).filter("frame % 2 = 0").select("utt_id", F.expr("frame div 2").alias("frame"), "f0")
    utts = orig.select("utt_id").distinct()
    where = F.explode(F.array(*[F.struct(F.lit(g).cast("bigint").alias("seg"), F.lit(a).cast("bigint").alias("f0"), F.lit(b).cast("bigint").alias("f1")) for g, a, b, _ in _PIECES]))
    ranges = utts.select("utt_id", where.alias("r")).select("utt_id", "r.*")
    parts = [syn.filter(F.col("frame").between(a, a + n - 1)).select(
        "utt_id", F.lit(g).cast("bigint").alias("seg"), (F.col("frame") - a).alias("i"), "codes") for g, a, _, n in _PIECES]
    grid = X.work_grid(utts.withColumn("path", F.concat(F.col("utt_id").cast("string"), F.lit(".wav"))), [52, 53], [0.3, 0.7], include_original=True)
    own = utts.select("utt_id", F.array(F.col("utt_id").cast("double"), F.lit(1.0)).alias("xvector"))
    out, _ = X.anonymize_recordings(raw, orig, parts[0].unionByName(parts[1]), ranges, B.codebook(spark, sf), B.LEVELS,
                                    B.pool(spark, sf), _pitch(spark, sf), grid, own, gate=False)
    shown = F.concat(F.slice("input", 1, 64), F.array(F.round(F.get("input", F.lit(64)), 3)), F.slice("input", F.lit(66), F.size("input")))
    return out.select("utt_id", "result", "frame", *digest(shown))


@query("P3_anonymize_speakers", f"""{_ANON},
v AS (SELECT seed, gender, xvector FROM stat JOIN vecs USING (seed, asked))
SELECT u.utt_id, CASE WHEN s.seed IS NULL THEN 'anonymized_' ELSE '' END || u.utt_id || '_' || s.tail AS result, v.gender,
  {sql_digest('(CASE WHEN s.seed IS NULL THEN [u.utt_id::DOUBLE, 1.0] ELSE v.xvector END)')}
FROM (SELECT DISTINCT utt_id FROM frames) u CROSS JOIN settings s LEFT JOIN v ON v.seed = s.seed""")
def anonymize_speakers(spark, sf):
    _, speakers = _anonymized(spark, sf)
    return speakers.select("utt_id", "result", "gender", *digest(F.col("xvector")))


@query("P3_anonymize_gate_and_noise", f"""{_ANON},
uo AS (SELECT utt_id, frame, {sql_unit('v')} AS u FROM (SELECT utt_id, frame, [c0, c1, c2, c3]::DOUBLE[] AS v FROM orig)),
us AS (SELECT utt_id, frame, {sql_unit('v')} AS u FROM (SELECT utt_id, frame, [c0, c1, c2, c3]::DOUBLE[] AS v FROM syn)),
corr AS (SELECT b.utt_id, b.frame, max(list_dot_product(b.u, a.u)) AS corr
  FROM us b JOIN uo a ON a.utt_id = b.utt_id AND a.frame BETWEEN b.frame - 2 AND b.frame + 2 GROUP BY b.utt_id, b.frame),
loud AS (SELECT utt_id, seed, avg(f0 * f0) AS power FROM ma GROUP BY utt_id, seed),
noisy AS (SELECT ma.utt_id, seed, frame, greatest(f0 + sqrt(power / 2.0)
    * {sql_normal("seed || ':' || ma.utt_id || ':' || seed || ':any:' || frame")}, 0.0) AS f0
  FROM ma JOIN loud USING (utt_id, seed))
SELECT f.utt_id, {_FRAME_RESULT}, f.frame,
  {r4('CASE WHEN s.seed IS NULL THEN f.f0 WHEN f.f0 = 0 THEN 0.0 ELSE n.f0 END')} AS f0,
  {sql_digest(f'''(CASE WHEN {_DRAWN} OR c.corr < 0.6 THEN [o.c0, o.c1, o.c2, o.c3] ELSE [y.c0, y.c1, y.c2, y.c3] END)''')}
FROM frames f CROSS JOIN settings s JOIN orig o USING (utt_id, frame) JOIN syn y USING (utt_id, frame) JOIN corr c USING (utt_id, frame)
LEFT JOIN noisy n ON n.utt_id = f.utt_id AND n.frame = f.frame AND n.seed = s.seed""")
def anonymize_full(spark, sf):
    out, _ = _anonymized(spark, sf, gate=True, noise=2.0)
    return out.select("utt_id", "result", "frame", B.r4(F.col("f0")).alias("f0"), *digest(F.col("vec")))


@query("P4_edit")
def edit(spark, sf):
    """Words of the conversations edit the frames of the user with the same id, spread over all of its frames."""
    base = base_frames(spark, sf)
    lengths = base.groupBy("utt_id").agg((F.max("frame") + 1).alias("n_frames"))
    words = B.words(spark, sf).join(lengths, "utt_id")
    last = words.groupBy("utt_id").agg(F.max("end").alias("last"))
    share = F.col("n_frames") / F.col("last") / 50  # 50 frames a second
    words = words.join(last, "utt_id").select("utt_id", "word_idx", "word", (F.col("start") * share).alias("start"), (F.col("end") * share).alias("end"))
    words = materialize(words, "edit-words")
    picked = words.filter("word_idx % 7 in (0, 1)").select("utt_id", "word_idx")
    counts = picked.groupBy("utt_id").agg(F.expr("count(1) div 2 + count(1) % 2").alias("n"))
    texts = counts.select("utt_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k")).withColumn("text", F.lit("R"))
    pieces = texts.select("utt_id", F.col("k").alias("op")).join(base.filter("frame % 5 = 0").withColumn("frame", F.expr("frame div 5")), "utt_id")
    out, _ = X.edit(base, words, picked, texts, pieces)
    return out.select("utt_id", "frame", B.r4(F.col("f0")).alias("f0"), *digest(F.col("vec")))


@query("P5_try_rows", """WITH t AS (SELECT doc_id, split_part(text, ' ', 1) AS w FROM documents)
SELECT doc_id, CASE WHEN length(w) % 4 <> 0 THEN 100 // (length(w) % 4) ELSE -1 END AS value,
  CASE WHEN length(w) % 4 = 0 THEN 'ZeroDivisionError: integer modulo' END AS error FROM t""")
def try_rows(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.substring_index("text", " ", 1).alias("w"))

    def share(n):
        if n % 4 == 0:
            raise ZeroDivisionError("integer modulo")
        return 100 // (n % 4)

    return H.try_rows(docs, share, "bigint", F.length("w")).select("doc_id", "value", "error").fillna(-1, ["value"])


def _release(spark, sf):
    sims = vector_pairs(spark, sf).select(
        F.concat(F.lit("beta"), (F.col("utt_id") % 3).cast("string")).alias("setting"), cosine(F.col("a"), F.col("b")).alias("similarity"))
    wers = pairs(spark, sf).withColumn("setting", F.concat(F.lit("beta"), (F.col("item_id") % 3).cast("string")))
    rules = spark.createDataFrame(
        [("mean_sim", None, 0.5, "FAIL"), ("min_sim", -0.3, None, "WARN"), ("mean_wer", None, 25.0, "FAIL"),
         ("corpus_wer", None, 30.0, "FAIL")], "metric string, low double, high double, otherwise string")
    return X.evaluate_release(B.timings(spark, sf), sims, wers, rules, {"gpu_usd_per_hour": 0.35}, total="error")


_RELEASE = f"""{_SIM}, {_WER.removeprefix('WITH ')},
sims AS (SELECT 'beta' || (utt_id % 3) AS setting, avg(sim) AS mean_sim, min(sim) AS min_sim FROM s GROUP BY utt_id % 3),
rates AS (SELECT 'beta' || (item_id % 3) AS setting, 100 * avg(edits / greatest(n_ref, 1)::DOUBLE) AS mean_wer,
            100 * sum(edits) / sum(n_ref) AS corpus_wer FROM e GROUP BY item_id % 3),
metrics AS (
  SELECT setting, 'mean_sim' AS metric, mean_sim AS value, mean_sim < 0.5 AS good, 'FAIL' AS bad FROM sims
  UNION ALL SELECT setting, 'min_sim', min_sim, min_sim > -0.3, 'WARN' FROM sims
  UNION ALL SELECT setting, 'mean_wer', mean_wer, mean_wer < 25, 'FAIL' FROM rates
  UNION ALL SELECT setting, 'corpus_wer', corpus_wer, corpus_wer < 30, 'FAIL' FROM rates),
checks AS (SELECT 'operating point ' || setting AS "check", metric, {r6('value')} AS value,
  CASE WHEN good THEN 'PASS' ELSE bad END AS status, printf('%s=%.3f', metric, value) AS detail FROM metrics)"""


@query("P6_pair_published", """SELECT source || '/' || doc_id || '_orig.wav' AS path,
  'out/' || doc_id || '_seed_' || (doc_id % 7) || '_anon.wav' AS published, doc_id % 7 AS seed FROM documents WHERE doc_id % 3 <> 0""")
def pair_published(spark, sf):
    """Two thirds of the documents have a published clip, some a second one and a file of another name."""
    docs = B.table(spark, sf, "documents").select("doc_id", "source")
    originals = docs.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_orig.wav")).alias("path"))
    seeds = F.explode(F.array(F.col("doc_id") % 7, F.col("doc_id") % 7 + F.lit(1)))
    there = docs.filter("doc_id % 3 <> 0").select("doc_id", seeds.alias("seed")).select(
        F.format_string("out/%d_seed_%d_anon.wav", "doc_id", "seed").alias("path"))
    other = docs.select(F.format_string("out/%d_seed_anon.wav", "doc_id").alias("path"))
    return C.pair_published(originals, there.unionByName(other))


@query("P6_release_checks", f"{_RELEASE} SELECT * FROM checks")
def release_checks(spark, sf):
    return _release(spark, sf)["checks"].withColumn("value", B.r6(F.col("value")))


@query("P6_release_totals", f"{_RELEASE} SELECT status, count(*) AS n FROM checks GROUP BY status")
def release_totals(spark, sf):
    return _release(spark, sf)["totals"]


@query("U1_map_model", f"WITH {B.FRAMES} SELECT utt_id, frame, {r6('f0 * 2 + 3')} AS score FROM frames")
def map_model(spark, sf):
    def score(model, batch):
        return pd.DataFrame({"utt_id": batch["utt_id"], "frame": batch["frame"],
                             "score": batch["f0"] * model["slope"] + model["offset"]})

    rows = B.frames(spark, sf).select("utt_id", "frame", "f0")
    out = H.map_model(rows, lambda: {"slope": 2.0, "offset": 3.0}, score, "utt_id bigint, frame bigint, score double", "line")
    return out.withColumn("score", B.r6(F.col("score")))


@query("U3_fold_frames", f"""WITH {B.FRAMES}
SELECT utt_id, count(*) AS n, {r6('sum(f0 * (frame + 1))')} AS weighted FROM frames GROUP BY utt_id""")
def fold_frames(spark, sf):
    def step(state, rows):
        utt, n, total = state or (int(rows["utt_id"].iloc[0]), 0, 0.0)
        f0 = rows["f0"].to_numpy()
        total += float(f0 @ np.arange(n + 1, n + 1 + len(f0)))
        return (utt, n + len(f0), total), None

    def finish(state):
        return pd.DataFrame([state], columns=["utt_id", "n", "weighted"])

    rows = B.frames(spark, sf).select("utt_id", "frame", "f0")
    out = H.fold_frames(rows, step, finish, "utt_id bigint, n bigint, weighted double")
    return out.withColumn("weighted", B.r6(F.col("weighted")))


def _folder(spark, name):
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("ST1_stream_anonymize", _ANON_FRAMES)
def stream_anonymize(spark, sf):
    """The full anonymization of recordings whose rows are spread over many files.

    One file a micro-batch, deliveries that overlap, and a stream that stops and
    restarts; a recording is worked on when its last row is there.
    """
    syn, orig = _shifted_codes(spark, sf)
    rows = B.frames(spark, sf).select("utt_id", "frame", "f0")
    for name, codes in (("orig", orig), ("syn", syn)):
        rows = rows.join(codes.select("utt_id", "frame", F.transform("codes", lambda c: c.cast("double")).alias(name)), ["utt_id", "frame"])
    expected = rows.groupBy("utt_id").agg(F.count(F.lit(1)).alias("n_rows"))
    pool, pitch = B.pool(spark, sf), _pitch(spark, sf)

    def process(done):
        utts = done.select("utt_id").distinct().withColumn("path", F.concat(F.col("utt_id").cast("string"), F.lit(".wav")))
        grid = X.work_grid(utts, [52, 53], [0.3, 0.7], include_original=True)
        streams = [done.select("utt_id", "frame", F.col(name).alias("vec")) for name in ("orig", "syn")]
        return X.anonymize(done.select("utt_id", "frame", "f0"), *streams, pool, pitch, grid, gate=False)[0]

    inbox, out, marks = _folder(spark, "inbox"), _folder(spark, "outbox"), _folder(spark, "marks")
    for part in (rows.filter("frame % 3 <> 1").repartition(2), rows.filter("frame % 3 <> 0").repartition(2)):
        part.write.mode("append").parquet(inbox)
        ST.stream_anonymize(spark, inbox, rows.schema, out, marks, process, expected, files_per_batch=1).awaitTermination()
    done = spark.read.parquet(f"{out}/results")
    return done.select("utt_id", "result", "frame", B.r4(F.col("f0")).alias("f0"), *digest(F.col("vec")))


@query("ST2_stream_progress", f"""WITH {B.TIMINGS} SELECT count(*) AS completed, {r6('avg(seconds)')} AS mean_seconds,
  {r6('100.0 * count(*) / (count(*) * 2)')} AS percent, {r6('count(*) * avg(seconds)')} AS eta_seconds FROM timings""")
def stream_progress(spark, sf):
    rows = B.timings(spark, sf).select("file", "seconds")
    inbox, name = _folder(spark, "finished"), f"progress_{uuid.uuid4().hex}"
    rows.write.parquet(inbox)
    stream = spark.readStream.schema(rows.schema).parquet(inbox)
    total = 2 * rows.count()
    q = ST.stream_progress(stream, total).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("completed", *[B.r6(F.col(c)).alias(c) for c in ("mean_seconds", "percent", "eta_seconds")])
