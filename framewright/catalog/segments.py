"""Registered queries: segments, words, alignments and frame windows (inventory section 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query, r6, sql_uniform
from framewright.operators import segments as G
from framewright.plans import bindings as B

_FR = f"WITH {B.FRAMES}"


def phones(spark, sf):
    """utt_id, frame, phone: ids 0..3 in runs, 3 is the blank."""
    return B.frames(spark, sf).select(
        "utt_id", "frame", F.expr("(event_id div 400 + (event_id % 5) div 3) % 4").alias("phone"))


_PHONES = "phones AS (SELECT utt_id, frame, (event_id // 400 + (event_id % 5) // 3) % 4 AS phone FROM frames)"


def first_codes(spark, sf):
    return B.codes(spark, sf).select("utt_id", "frame", F.col("codes")[0].cast("bigint").alias("code"))


_CODE0 = "code0 AS (SELECT utt_id, frame, c0 AS code FROM codes)"
_CODES = f"{_FR}, {B.CODES_SQL}, {_CODE0}"


def _merge_sql(min_words: int, min_chars: int) -> str:
    short = f"(f.nw < {min_words} OR length(f.t) < {min_chars})"
    ws = r"E' \n\t\r'"
    return f"""WITH RECURSIVE {B.SEGMENTS},
f AS (
  SELECT utt_id, seg, seg AS first_seg, len(words) AS nw, text AS t, "end" FROM segments WHERE seg = 0
  UNION ALL
  SELECT s.utt_id, s.seg, CASE WHEN {short} THEN f.first_seg ELSE s.seg END,
         CASE WHEN {short} THEN f.nw ELSE 0 END + len(s.words),
         CASE WHEN {short} THEN trim(f.t, {ws}) || ' ' || trim(s.text, {ws}) ELSE s.text END, s."end"
  FROM f JOIN segments s ON s.utt_id = f.utt_id AND s.seg = f.seg + 1),
g AS (SELECT utt_id, first_seg, max(seg) AS last_seg, max("end") AS "end", arg_max(t, seg) AS t,
             arg_max(nw, seg) AS n_words FROM f GROUP BY utt_id, first_seg)
SELECT g.utt_id, g.first_seg, g.last_seg, {r6('s.start')} AS start, {r6('g."end"')} AS "end",
       g.t AS text, g.n_words FROM g JOIN segments s ON s.utt_id = g.utt_id AND s.seg = g.first_seg"""


def _merge(spark, sf, min_words, min_chars):
    out = G.merge_segments(B.segments(spark, sf).drop("first_word"), min_words, min_chars)
    return out.select(
        "utt_id", "first_seg", "last_seg", B.r6(F.col("start")).alias("start"),
        B.r6(F.col("end")).alias("end"), "text", F.size("words").cast("bigint").alias("n_words"))


@query("G1_merge_segments", _merge_sql(30, 70))
def merge(spark, sf):
    return _merge(spark, sf, 30, 70)


@query("G1_merge_segments_long", _merge_sql(150, 900))
def merge_long(spark, sf):
    return _merge(spark, sf, 150, 900)


@query("G2_segment_frames", f"""WITH {B.SEGMENTS},
u AS (SELECT utt_id, max("end") AS duration, (round_even(max("end") * 48.7, 0))::BIGINT AS n FROM segments GROUP BY utt_id),
r AS (SELECT s.utt_id, s.seg, greatest(round_even(s.start / u.duration * u.n, 0)::BIGINT, 0) AS f0,
             least(round_even(s."end" / u.duration * u.n, 0)::BIGINT, u.n) AS f1
      FROM segments s JOIN u USING (utt_id) WHERE u.duration > 0)
SELECT * FROM r WHERE f0 < f1""")
def segment_frames(spark, sf):
    segs = B.segments(spark, sf)
    utts = segs.groupBy("utt_id").agg(
        F.max("end").alias("duration"), F.bround(F.max("end") * 48.7, 0).cast("bigint").alias("n_frames"))
    return G.segment_frames(segs, utts.filter("duration > 0"))


_RANGES = """ranges AS (
  SELECT utt_id, k AS seg, k * 9 + utt_id % 4 AS f0, k * 9 + utt_id % 4 + 6 + k AS f1
  FROM (SELECT DISTINCT utt_id FROM frames) CROSS JOIN (SELECT unnest(range(0, 5)) AS k))"""


def ranges(spark, sf):
    """utt_id, seg, f0, f1: five ranges per recording, the last two overlapping."""
    utts = B.frames(spark, sf).select("utt_id").distinct()
    k = utts.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    start = F.col("seg") * 9 + F.col("utt_id") % 4
    return k.select("utt_id", "seg", start.alias("f0"), (start + 6 + F.col("seg")).alias("f1"))


@query("G3_frames_in_segments", f"""{_FR}, {_RANGES}
SELECT r.utt_id, r.seg, f.frame, f.frame - r.f0 AS "offset" FROM frames f
JOIN ranges r ON r.utt_id = f.utt_id AND f.frame >= r.f0 AND f.frame < r.f1""")
def frames_in_segments(spark, sf):
    out = G.frames_in_segments(B.frames(spark, sf).select("utt_id", "frame"), ranges(spark, sf))
    return out.select("utt_id", "seg", "frame", "offset")


@query("G4_alignment_runs", f"""{_FR}, {_PHONES},
n AS (SELECT *, lag(phone) OVER (PARTITION BY utt_id ORDER BY frame) AS prev FROM phones WHERE phone <> 3),
s AS (SELECT utt_id, frame, phone, row_number() OVER (PARTITION BY utt_id ORDER BY frame) - 1 AS run,
             lead(frame) OVER (PARTITION BY utt_id ORDER BY frame) AS nxt FROM n WHERE prev IS DISTINCT FROM phone)
SELECT utt_id, run, phone, CASE WHEN run = 0 THEN 0 ELSE frame END AS start,
       coalesce(nxt, (SELECT count(*) FROM phones p WHERE p.utt_id = s.utt_id)) AS "end" FROM s""")
def alignment_runs(spark, sf):
    return G.alignment_runs(phones(spark, sf), blank=3)


@query("G5_ctc_hold", f"""{_FR}, {_PHONES}
SELECT utt_id, frame, coalesce(last_value(CASE WHEN phone <> 3 THEN phone END IGNORE NULLS)
  OVER (PARTITION BY utt_id ORDER BY frame), 0) AS held FROM phones""")
def ctc_hold(spark, sf):
    return G.ctc_hold(phones(spark, sf), blank=3).select("utt_id", "frame", "held")


@query("G6_word_bounds", f"""WITH {B.DURATIONS},
c AS (SELECT *, sum(dur) OVER (PARTITION BY utt_id ORDER BY pos) AS after FROM durations),
z AS (SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY pos) - 1 AS word_no, after::BIGINT AS x0,
             lead((after - dur)::BIGINT) OVER (PARTITION BY utt_id ORDER BY pos) AS x1 FROM c WHERE symbol_id = 0)
SELECT * FROM z WHERE x1 IS NOT NULL""")
def word_bounds(spark, sf):
    return G.word_bounds(B.durations(spark, sf))


@query("G7_word_timestamps", f"""WITH {B.SEGMENTS},
b AS (SELECT utt_id, seg, unnest(range(0, greatest(len(words) - seg % 3 + utt_id % 2, 0))) AS word_no FROM segments)
SELECT s.utt_id, s.seg, b.word_no, s.words[b.word_no + 1] AS word,
  {r6('s.start + (b.word_no * 10 - 3) / 50.0')} AS start, {r6('s.start + (b.word_no * 10 + 8 + 1.5) / 50.0')} AS "end"
FROM segments s JOIN b USING (utt_id, seg) WHERE b.word_no < len(s.words)""")
def word_timestamps(spark, sf):
    segs = B.segments(spark, sf)
    n = F.size("words") - F.col("seg") % 3 + F.col("utt_id") % 2
    bounds = segs.filter(n > 0).select("utt_id", "seg", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("word_no"))
    bounds = bounds.withColumn("x0", F.col("word_no") * 10).withColumn("x1", F.col("word_no") * 10 + 8)
    out = G.word_timestamps(bounds, segs)
    return out.select("utt_id", "seg", F.col("word_no").cast("bigint").alias("word_no"), "word",
                      B.r6(F.col("start")).alias("start"), B.r6(F.col("end")).alias("end"))


@query("G8_expand_by_duration", f"""WITH {B.DURATIONS},
t AS (SELECT *, round_even(dur * 1.5, 0)::BIGINT AS times FROM durations),
a AS (SELECT *, coalesce(sum(times) OVER (PARTITION BY utt_id ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM t)
SELECT utt_id, pos, symbol_id, first + unnest(range(0, times)) AS frame FROM a""")
def expand(spark, sf):
    return G.expand_by_duration(B.durations(spark, sf), scale=1.5).select("utt_id", "pos", "symbol_id", "frame")


@query("G9_context_frames", f"""WITH {B.DURATIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY pos) - 1 AS idx,
             count(*) OVER (PARTITION BY utt_id) AS n, min(pos) OVER (PARTITION BY utt_id) AS lo,
             max(pos) OVER (PARTITION BY utt_id) AS hi FROM durations)
SELECT utt_id, sum(CASE WHEN pos - lo < utt_id % 3 + 1 THEN dur ELSE 0 END)::BIGINT AS prefix_frames,
       sum(CASE WHEN pos - lo >= hi - lo + 1 - (utt_id % 2 + 1) THEN dur ELSE 0 END)::BIGINT AS postfix_frames
FROM n GROUP BY utt_id""")
def context_frames(spark, sf):
    return G.context_frames(B.durations(spark, sf), F.col("utt_id") % 3, F.col("utt_id") % 2)


@query("G10_overlay_segments", f"""{_CODES}, {_RANGES},
gen AS (SELECT utt_id, seg, unnest(range(0, 4 + seg * 3)) AS i FROM ranges),
p AS (SELECT g.utt_id, r.f0 + g.i AS frame, arg_max(100 + g.seg * 20 + g.i, g.seg) AS code
      FROM gen g JOIN ranges r USING (utt_id, seg) WHERE r.f0 + g.i < r.f1 GROUP BY ALL)
SELECT c.utt_id, c.frame, coalesce(p.code, c.code) AS code FROM code0 c LEFT JOIN p USING (utt_id, frame)""")
def overlay(spark, sf):
    where = ranges(spark, sf)
    gen = where.select("utt_id", "seg", F.explode(F.sequence(
        F.lit(0).cast("bigint"), 3 + F.col("seg") * 3)).alias("i"))
    gen = gen.withColumn("code", 100 + F.col("seg") * 20 + F.col("i"))
    return G.overlay_segments(first_codes(spark, sf), gen, where, "code")


_TAIL = "tail AS (SELECT utt_id, frame, CASE WHEN frame > 20 + utt_id % 30 THEN 0 ELSE code END AS code FROM code0)"


def tailed(spark, sf):
    return first_codes(spark, sf).withColumn(
        "code", F.when(F.col("frame") > 20 + F.col("utt_id") % 30, 0).otherwise(F.col("code")))


@query("G11_trim_tail", f"""{_CODES}, {_TAIL}
SELECT utt_id, frame, code FROM (SELECT *, max(CASE WHEN code <> 0 THEN frame END) OVER (PARTITION BY utt_id) AS hi FROM tail)
WHERE hi IS NULL OR frame <= hi""")
def trim_tail(spark, sf):
    return G.trim_tail(tailed(spark, sf), F.col("code") != 0)


@query("G12_mask_after_eos", f"""{_CODES}
SELECT utt_id, frame, CASE WHEN frame > e THEN -1 ELSE code END AS code FROM (
  SELECT *, min(CASE WHEN code = 1024 THEN frame END) OVER (PARTITION BY utt_id) AS e FROM code0)""")
def mask_after(spark, sf):
    return G.mask_after_eos(first_codes(spark, sf), B.EOS)


@query("G12_append_eos", f"""{_CODES}, {_TAIL},
x AS (SELECT * FROM tail UNION ALL SELECT utt_id, max(frame) + 1, 0 FROM tail GROUP BY utt_id)
SELECT utt_id, frame, CASE WHEN frame = coalesce(hi + 1, 0) THEN 1024 ELSE code END AS code FROM (
  SELECT *, max(CASE WHEN code <> 0 THEN frame END) OVER (PARTITION BY utt_id) AS hi FROM x)""")
def append_eos(spark, sf):
    return G.append_eos(tailed(spark, sf), B.EOS)


@query("G13_cut_at_eos", f"""{_CODES}
SELECT utt_id, frame, code FROM (
  SELECT *, min(CASE WHEN code = 1024 THEN frame END) OVER (PARTITION BY utt_id) AS e FROM code0)
WHERE e IS NULL OR frame < e""")
def cut_at_eos(spark, sf):
    return G.cut_at_eos(first_codes(spark, sf), F.col("code") == B.EOS)


@query("G14_unique_consecutive", f"""{_FR}, {_PHONES}
SELECT utt_id, frame, phone FROM (SELECT *, lag(phone) OVER (PARTITION BY utt_id ORDER BY frame) AS p FROM phones)
WHERE p IS DISTINCT FROM phone""")
def unique_consecutive(spark, sf):
    return G.unique_consecutive(phones(spark, sf), "phone")


@query("G15_chunk_frames", f"""{_CODES},
n AS (SELECT utt_id, max(frame) + 1 AS n FROM code0 GROUP BY utt_id),
s AS (SELECT utt_id, unnest(range(0, ((n - 1) // 16 + 1) * 16)) AS frame FROM n)
SELECT utt_id, frame // 16 // 2 AS chunk_group, frame // 16 AS chunk, frame % 16 AS pos, coalesce(code, -1) AS code
FROM s LEFT JOIN code0 USING (utt_id, frame)""")
def chunk(spark, sf):
    return G.chunk_frames(first_codes(spark, sf), 16, -1, group=2)


def _curtail_sql(cond: str) -> str:
    return f"""{_CODES}
SELECT utt_id, frame, code FROM (SELECT *, count(*) OVER (PARTITION BY utt_id) AS n FROM code0) WHERE {cond}"""


@query("G16_curtail", _curtail_sql("frame < n // 16 * 16"))
def curtail(spark, sf):
    return G.curtail(first_codes(spark, sf), 16)


@query("G16_curtail_from_left", _curtail_sql("frame >= n - n // 16 * 16"))
def curtail_left(spark, sf):
    return G.curtail(first_codes(spark, sf), 16, from_left=True)


@query("G16_truncate_to", _curtail_sql("frame < 30 + utt_id % 20"))
def truncate(spark, sf):
    codes = first_codes(spark, sf)
    want = codes.select("utt_id").distinct().withColumn("n_target", 30 + F.col("utt_id") % 20)
    return G.truncate_to(codes, want)


@query("G17_align_min", f"""{_FR}, {B.SECOND_F0}
SELECT a.utt_id, a.frame, {r6('a.f0')} AS fa, {r6('b.f0')} AS fb FROM frames a JOIN second_f0 b USING (utt_id, frame)""")
def align_min(spark, sf):
    a = B.frames(spark, sf).select("utt_id", "frame", B.r6(F.col("f0")).alias("fa"))
    b = B.second_f0(spark, sf).select("utt_id", "frame", B.r6(F.col("f0")).alias("fb"))
    return G.align_min(a, b)


@query("G18_crop_streams", f"""{_CODES},
f AS (SELECT utt_id, frame, f0 FROM frames WHERE frame % 2 = 0),
h AS (SELECT utt_id, frame // 2 AS frame FROM f),
s AS (SELECT c.utt_id, c.n AS nc, x.n AS nf FROM (SELECT utt_id, count(*) AS n FROM code0 GROUP BY utt_id) c
      JOIN (SELECT utt_id, count(*) AS n FROM h GROUP BY utt_id) x USING (utt_id))
SELECT 'codes' AS stream, utt_id, frame FROM code0 WHERE frame < 60
UNION ALL SELECT 'f0', h.utt_id, h.frame FROM h JOIN s USING (utt_id)
WHERE s.nc <= 60 OR h.frame < floor(60.0::DOUBLE / s.nc * s.nf)""")
def crop_streams(spark, sf):
    codes = first_codes(spark, sf)
    half = B.frames(spark, sf).filter("frame % 2 = 0").select("utt_id", F.expr("frame div 2").alias("frame"))
    _, c, f = G.crop_streams(codes, codes, half, 60)
    return c.select(F.lit("codes").alias("stream"), "utt_id", "frame").unionByName(
        f.select(F.lit("f0").alias("stream"), "utt_id", "frame"))


_CROP = f"""n AS (SELECT utt_id, count(*) AS n FROM code0 GROUP BY utt_id),
st AS (SELECT utt_id, n, CASE WHEN n - {{size}} + 1 > 1
        THEN floor({sql_uniform("'9:' || utt_id || ':crop'")} * (n - {{size}} + 1))::BIGINT ELSE 0 END AS start FROM n)"""


@query("G19_random_crop", f"""{_CODES}, {_CROP.format(size=64)}
SELECT s.utt_id, s.frame, coalesce(c.code, 0) AS code FROM (SELECT *, unnest(range(0, 64)) AS frame FROM st) s
LEFT JOIN code0 c ON c.utt_id = s.utt_id AND c.frame = s.start + s.frame""")
def random_crop(spark, sf):
    return G.random_crop(first_codes(spark, sf), 64, 9, "code")


@query("G19_paired_crop", f"""{_CODES}, {_CROP.format(size=8)},
w AS (SELECT utt_id, frame * 4 + j AS frame, code * 4 + j AS sample FROM code0 CROSS JOIN (SELECT unnest(range(0, 4)) AS j))
SELECT 'frame' AS kind, s.utt_id, s.frame, coalesce(c.code, 0) AS v FROM (SELECT *, unnest(range(0, 8)) AS frame FROM st) s
LEFT JOIN code0 c ON c.utt_id = s.utt_id AND c.frame = s.start + s.frame
UNION ALL
SELECT 'sample', s.utt_id, s.frame, coalesce(w.sample, 0) FROM (SELECT *, unnest(range(0, 30)) AS frame FROM st) s
LEFT JOIN w ON w.utt_id = s.utt_id AND w.frame = s.start * 4 + s.frame""")
def paired_crop(spark, sf):
    codes = first_codes(spark, sf)
    samples = codes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "utt_id", (F.col("frame") * 4 + F.col("j")).alias("frame"), (F.col("code") * 4 + F.col("j")).alias("sample"))
    f, s = G.paired_crop(codes, samples, 30, 4, 9, "code", "sample")
    return f.select(F.lit("frame").alias("kind"), "utt_id", "frame", F.col("code").alias("v")).unionByName(
        s.select(F.lit("sample").alias("kind"), "utt_id", "frame", F.col("sample").alias("v")))
