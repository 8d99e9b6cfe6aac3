"""Registered queries: span editing (inventory section 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.mixing import digest, sql_digest
from framewright.catalog.registry import query, r4, r6
from framewright.operators import editing as E
from framewright.operators import series as S
from framewright.plans import bindings as B

_W = f"WITH {B.SEGMENTS}, {B.WORDS}"
_GROUPS = """picked AS (SELECT utt_id, word_idx FROM words WHERE word_idx % 7 IN (0, 1)),
runs AS (SELECT utt_id, word_idx, word_idx - row_number() OVER (PARTITION BY utt_id ORDER BY word_idx) AS run FROM picked),
groups AS (
  SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY min(word_idx)) - 1 AS group_no,
         min(word_idx) AS first, max(word_idx) AS last, count(*) AS n_words FROM runs GROUP BY utt_id, run)"""
_SPANS = """spans AS (
  SELECT g.*, greatest(round_even(a.start * 50, 0)::BIGINT, 0) AS start_frame, round_even(b."end" * 50, 0)::BIGINT AS end_frame
  FROM groups g JOIN words a ON a.utt_id = g.utt_id AND a.word_idx = g.first
  JOIN words b ON b.utt_id = g.utt_id AND b.word_idx = g.last)"""


def groups(spark, sf):
    return E.group_consecutive(B.words(spark, sf).filter("word_idx % 7 in (0, 1)"))


@query("E1_group_consecutive", f"{_W}, {_GROUPS} SELECT * FROM groups")
def group_consecutive(spark, sf):
    return groups(spark, sf)


@query("E2_group_spans", f"{_W}, {_GROUPS}, {_SPANS} SELECT * FROM spans")
def group_spans(spark, sf):
    return E.group_spans(groups(spark, sf), B.words(spark, sf))


def texts(spark, sf):
    """utt_id, k, text: one text per group, one too few for every fifth recording."""
    g = groups(spark, sf)
    n = g.groupBy("utt_id").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, "utt_id").filter("utt_id % 5 <> 0 or group_no < n - 1").select(
        "utt_id", F.col("group_no").alias("k"), F.concat(F.lit("R"), F.col("group_no").cast("string")).alias("text"))


@query("E3_pair_replacements", f"""{_W}, {_GROUPS},
c AS (SELECT utt_id, count(*) AS n, CASE WHEN utt_id % 5 = 0 THEN count(*) - 1 ELSE count(*) END AS t FROM groups GROUP BY utt_id)
SELECT g.utt_id, g.group_no, g.first, g.last, g.n_words, 'R' || g.group_no AS text, NULL::VARCHAR AS error
FROM groups g JOIN c USING (utt_id) WHERE n = t
UNION ALL SELECT utt_id, -1, -1, -1, -1, NULL, t || ' texts for ' || n || ' groups' FROM c WHERE n <> t""")
def pair_replacements(spark, sf):
    out = E.pair_replacements(groups(spark, sf), texts(spark, sf))
    return out.fillna(-1, ["group_no", "first", "last", "n_words"])


_CHUNK = f"""WITH {B.FRAMES}, {B.CODES_SQL},
n AS (SELECT utt_id, count(*) AS n FROM frames GROUP BY utt_id),
p AS (SELECT c.utt_id, c.frame - greatest(10 + c.utt_id % 3 - 8, 0) AS frame, c.c0 AS code FROM codes c JOIN n USING (utt_id)
      WHERE c.frame >= greatest(10 + c.utt_id % 3 - 8, 0) AND c.frame < least(n, n - (5 + c.utt_id % 7) + 8))"""


@query("E4_extend_chunk", f"""{_CHUNK}
SELECT utt_id, frame, code FROM (
  SELECT *, min(CASE WHEN code = 1024 THEN frame END) OVER (PARTITION BY utt_id) AS e FROM p)
WHERE e IS NULL OR frame < e""")
def extend_chunk(spark, sf):
    from framewright.operators.scans import with_totals

    codes = B.codes(spark, sf).select("utt_id", "frame", F.col("codes")[0].cast("bigint").alias("code"))
    codes = with_totals(codes, "utt_id", [F.count(F.lit(1)).alias("n")])
    out = E.extend_chunk(codes, 10 + F.col("utt_id") % 3, 5 + F.col("utt_id") % 7, F.col("n"),
                         marker=F.col("code") == B.EOS)
    return out.select("utt_id", "frame", "code")


def base_frames(spark, sf):
    """utt_id, frame, f0, vec: a short vector per frame."""
    return B.frames(spark, sf).select(
        "utt_id", "frame", "f0",
        F.array((F.col("event_id") % 7).cast("double"), F.col("f0") / 10, F.col("frame").cast("double")).alias("vec"))


def pieces(spark, sf, keep=None):
    """A replacement of 6 + utt_id % 9 frames, taken from the recording itself."""
    rows = base_frames(spark, sf).filter(F.col("frame") < 6 + F.col("utt_id") % 9)
    return rows.select("utt_id", "frame", (F.col("f0") * 2).alias("f0"),
                       F.transform("vec", lambda x: x + 100).alias("vec"))


_BASE = f"""WITH {B.FRAMES},
base AS (SELECT utt_id, frame, f0, [(event_id % 7)::DOUBLE, f0 / 10, frame::DOUBLE] AS vec FROM frames),
n AS (SELECT utt_id, count(*) AS n FROM base GROUP BY utt_id),
piece AS (SELECT utt_id, frame, f0 * 2 AS f0, [vec[1] + 100, vec[2] + 100, vec[3] + 100] AS vec FROM base WHERE frame < 6 + utt_id % 9)"""


def _sql_append(name: str, a: str, b: str, width: int) -> str:
    """``a`` and ``b`` are tables (utt_id, frame, f0, vec)."""
    mix = ", ".join(f"a.vec[{d}] * (1 - b.i / (l.w + 1.0::DOUBLE)) + b.vec[{d}] * (b.i / (l.w + 1.0::DOUBLE))" for d in (1, 2, 3))
    return f"""{name}_l AS (SELECT utt_id, coalesce(na, 0) AS na, least({width}, coalesce(na, 0), coalesce(nb, 0)) AS w
  FROM (SELECT utt_id, max(frame) + 1 AS na FROM {a} GROUP BY utt_id)
  FULL JOIN (SELECT utt_id, max(frame) + 1 AS nb FROM {b} GROUP BY utt_id) USING (utt_id)),
{name}_b AS (SELECT b.utt_id, l.na - l.w + b.frame AS frame, b.frame + 1 AS i, b.f0, b.vec FROM {b} b JOIN {name}_l l USING (utt_id)),
{name} AS (SELECT coalesce(a.utt_id, b.utt_id) AS utt_id, coalesce(a.frame, b.frame) AS frame,
    CASE WHEN a.frame IS NOT NULL AND b.frame IS NOT NULL THEN a.f0 * 0.5 + b.f0 * 0.5 ELSE coalesce(a.f0, b.f0) END AS f0,
    CASE WHEN a.frame IS NOT NULL AND b.frame IS NOT NULL THEN [{mix}] ELSE coalesce(a.vec, b.vec) END AS vec
  FROM {a} a FULL JOIN {name}_b b ON a.utt_id = b.utt_id AND a.frame = b.frame
  JOIN {name}_l l ON l.utt_id = coalesce(a.utt_id, b.utt_id))"""


_OUT = f"utt_id, frame, {r6('f0')} AS f0, {sql_digest('vec')}"


def show(df):
    return df.select("utt_id", "frame", B.r6(F.col("f0")).alias("f0"), *digest(F.col("vec")))


@query("E5_crossfade_append", f"{_BASE}, {_sql_append('x', 'base', 'piece', 8)} SELECT {_OUT} FROM x")
def crossfade(spark, sf):
    return show(E.crossfade_append(base_frames(spark, sf), pieces(spark, sf), 8))


def _splice_sql(k: int) -> str:
    return f"""{_BASE},
pre AS (SELECT * FROM base WHERE frame < 4 + utt_id % 20),
post AS (SELECT utt_id, frame - (16 + utt_id % 20) AS frame, f0, vec FROM base WHERE frame >= 16 + utt_id % 20),
{_sql_append('x', 'pre', 'piece', k)}, {_sql_append('y', 'x', 'post', k)} SELECT {_OUT} FROM y"""


def one_span(spark, sf):
    utts = B.frames(spark, sf).select("utt_id").distinct()
    return utts.select("utt_id", (4 + F.col("utt_id") % 20).alias("start_frame"),
                       (16 + F.col("utt_id") % 20).alias("end_frame"))


@query("E6_graft_splice", _splice_sql(8))
def graft(spark, sf):
    return show(E.graft_splice(base_frames(spark, sf), pieces(spark, sf), one_span(spark, sf), 8))


@query("E8_hard_splice", _splice_sql(0))
def hard(spark, sf):
    return show(E.hard_splice(base_frames(spark, sf), pieces(spark, sf), one_span(spark, sf)))


@query("E7_apply_one_splice", _splice_sql(8))
def splice_one(spark, sf):
    ops = one_span(spark, sf).withColumn("op", F.lit(0).cast("bigint"))
    repl = pieces(spark, sf).withColumn("op", F.lit(0).cast("bigint"))
    return show(E.apply_splices(base_frames(spark, sf), ops, repl, 8))


_TWICE = f"""{_BASE},
pre2 AS (SELECT * FROM base WHERE frame < 30),
post2 AS (SELECT utt_id, frame - 36 AS frame, f0, vec FROM base WHERE frame >= 36),
{_sql_append('x2', 'pre2', 'piece', 3)}, {_sql_append('y2', 'x2', 'post2', 3)},
pre1 AS (SELECT * FROM y2 WHERE frame < 6 + utt_id % 5),
post1 AS (SELECT utt_id, frame - (14 + utt_id % 19) AS frame, f0, vec FROM y2 WHERE frame >= 14 + utt_id % 19),
{_sql_append('x1', 'pre1', 'piece', 3)}, {_sql_append('y1', 'x1', 'post1', 3)}"""


def two_ops(spark, sf):
    """Two spans per recording whose distance runs from far to overlapping seams."""
    utts = B.frames(spark, sf).select("utt_id").distinct()
    first = utts.select("utt_id", F.lit(0).cast("bigint").alias("op"), (6 + F.col("utt_id") % 5).alias("start_frame"),
                        (14 + F.col("utt_id") % 19).alias("end_frame"))
    second = utts.select("utt_id", F.lit(1).cast("bigint").alias("op"), F.lit(30).cast("bigint").alias("start_frame"),
                         F.lit(36).cast("bigint").alias("end_frame"))
    return first.unionByName(second)


@query("E7_apply_splices", f"{_TWICE} SELECT {_OUT} FROM y1")
def splice_two(spark, sf):
    ops = two_ops(spark, sf)
    repl = ops.select("utt_id", "op").join(pieces(spark, sf), "utt_id")
    return show(E.apply_splices(base_frames(spark, sf), ops, repl, 3))


@query("U2_splice_with_pitch_conversion", f"""{_BASE.replace('piece AS', 'raw AS')},
o AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM base WHERE f0 > 0 GROUP BY utt_id),
q AS (SELECT utt_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s FROM raw WHERE f0 > 0 GROUP BY utt_id),
piece AS (SELECT r.utt_id, r.frame, CASE WHEN r.f0 = 0 THEN 0.0 ELSE
    exp((ln(greatest(r.f0, 1e-9)) - q.m) / greatest(q.s, 1e-8) * o.s + o.m) END AS f0, r.vec
  FROM raw r JOIN q USING (utt_id) JOIN o USING (utt_id)),
pre AS (SELECT * FROM base WHERE frame < 4 + utt_id % 20),
post AS (SELECT utt_id, frame - (16 + utt_id % 20) AS frame, f0, vec FROM base WHERE frame >= 16 + utt_id % 20),
{_sql_append('x', 'pre', 'piece', 8)}, {_sql_append('y', 'x', 'post', 8)}
SELECT utt_id, frame, {r4('f0')} AS f0, {sql_digest('vec')} FROM y""")
def splice_converted(spark, sf):
    base = base_frames(spark, sf)
    ops = one_span(spark, sf).withColumn("op", F.lit(0).cast("bigint"))
    repl = pieces(spark, sf).withColumn("op", F.lit(0).cast("bigint"))
    out = E.apply_splices(base, ops, repl, 8, convert=lambda piece: S.match_own_pitch(piece, base))
    return out.select("utt_id", "frame", B.r4(F.col("f0")).alias("f0"), *digest(F.col("vec")))


_EDITED = """edited AS (
  SELECT w.utt_id, w.word_idx, w.word, false AS replaced FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM groups g WHERE g.utt_id = w.utt_id AND w.word_idx BETWEEN g.first AND g.last)
  UNION ALL SELECT utt_id, first, 'R' || group_no, true FROM groups)"""


@query("E9_edit_transcript", f"{_W}, {_GROUPS}, {_EDITED} SELECT * FROM edited")
def edit_transcript(spark, sf):
    spans = groups(spark, sf).withColumn("text", F.concat(F.lit("R"), F.col("group_no").cast("string")))
    return E.edit_transcript(B.words(spark, sf), spans)


_LISTED = f"""{_W}
SELECT utt_id, word_idx, printf('%5d | %s | %.2f -> %.2f', word_idx, word, start, "end") AS line FROM words"""


@query("E9_list_words", _LISTED)
def list_words(spark, sf):
    return E.list_words(B.words(spark, sf))


@query("E9_list_words_first_200", f"{_LISTED} WHERE word_idx < 200")
def list_first_words(spark, sf):
    return E.list_words(B.words(spark, sf), 200)


@query("E10_longest_word", f"""{_W}
SELECT utt_id, word_idx, word FROM (
  SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY length(word) DESC, word_idx) AS rk FROM words) WHERE rk = 1""")
def longest_word(spark, sf):
    return E.longest_word(B.words(spark, sf))


@query("E11_tag_entities", rf"""{_W},
terms AS (SELECT DISTINCT trim(lower(t), '.,!?') AS term FROM (
  SELECT unnest(regexp_split_to_array(text, '[ \n\t\r]+')) AS t FROM benchmark) WHERE length(trim(lower(t), '.,!?')) >= 10),
n AS (SELECT *, regexp_replace(lower(word), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS term FROM words)
SELECT utt_id, word_idx, word, 'NAME' AS label FROM words WHERE regexp_matches(word, '^\p{{Lu}}\p{{Ll}}{{6,}}')
UNION SELECT utt_id, word_idx, word, 'LONG' FROM words WHERE regexp_matches(word, '^.{{16,}}$')
UNION SELECT n.utt_id, n.word_idx, n.word, 'TERM' FROM n JOIN terms USING (term)""")
def tag_entities(spark, sf):
    terms = B.table(spark, sf, "benchmark").select(F.explode(B.split_words(F.col("text"))).alias("t"))
    terms = terms.select(F.btrim(F.lower("t"), F.lit(".,!?")).alias("term")).filter("length(term) >= 10").distinct()
    return E.tag_entities(
        B.words(spark, sf), [("NAME", r"^\p{Lu}\p{Ll}{6,}"), ("LONG", r"^.{16,}$")],
        terms.withColumn("label", F.lit("TERM")))


# Phrases of two and three words of the conversations themselves, and single words that overlap them.
@query("E11_tag_phrases", rf"""WITH RECURSIVE {_W.removeprefix('WITH ')},
n AS (SELECT utt_id, word_idx, word, regexp_replace(lower(word), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') AS t FROM words),
g AS (SELECT a.utt_id, a.word_idx AS first, a.word_idx + k - 1 AS last,
        CASE k WHEN 1 THEN a.t WHEN 2 THEN a.t || ' ' || b.t ELSE a.t || ' ' || b.t || ' ' || c.t END AS gram, k
      FROM n a CROSS JOIN (SELECT unnest([1, 2, 3]) AS k) LEFT JOIN n b ON b.utt_id = a.utt_id AND b.word_idx = a.word_idx + 1
        LEFT JOIN n c ON c.utt_id = a.utt_id AND c.word_idx = a.word_idx + 2),
terms AS (SELECT DISTINCT gram, k, 'P' || k AS label FROM g WHERE gram IS NOT NULL AND len(string_split(gram, ' ')) = k
      AND NOT list_contains(string_split(gram, ' '), '') AND ((k = 2 AND first % 11 = 0) OR (k = 3 AND first % 17 = 0) OR (k = 1 AND first % 37 = 5))),
m AS (SELECT utt_id, first, last, label FROM g JOIN terms USING (gram, k)),
best AS (SELECT utt_id, first, max(last) AS last FROM m GROUP BY utt_id, first),
pick AS (
  SELECT utt_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY first) AS r FROM best) WHERE r = 1
  UNION ALL SELECT utt_id, first, last FROM (
    SELECT b.*, row_number() OVER (PARTITION BY b.utt_id ORDER BY b.first) AS r FROM pick p JOIN best b ON b.utt_id = p.utt_id AND b.first > p.last) WHERE r = 1)
SELECT DISTINCT w.utt_id, w.word_idx, w.word, m.label FROM pick JOIN m USING (utt_id, first, last)
JOIN words w ON w.utt_id = pick.utt_id AND w.word_idx BETWEEN pick.first AND pick.last""")
def tag_phrases(spark, sf):
    words = B.words(spark, sf)
    clean = F.regexp_replace(F.lower("word"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    at = words.select("utt_id", "word_idx", clean.alias("t"))
    parts = at.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "t"))).alias("ws")).select(F.col("ws.t").alias("ts"))
    terms = None
    for k, every, rest in ((2, 11, 0), (3, 17, 0), (1, 37, 5)):
        starts = f"filter(sequence(0, size(ts) - {k}), i -> i % {every} = {rest})"
        grams = parts.filter(F.size("ts") >= k).select(F.explode(F.expr(f"transform({starts}, i -> slice(ts, i + 1, {k}))")).alias("p"))
        grams = grams.filter("not array_contains(p, '')").select(F.array_join("p", " ").alias("term"), F.lit(f"P{k}").alias("label")).distinct()
        terms = grams if terms is None else terms.unionByName(grams)
    return E.tag_entities(words, dictionary=terms)


@query("T11_context_strings", f"""{_W}, {_GROUPS},
c AS (SELECT g.utt_id, g.group_no, string_agg(w.word, ' ' ORDER BY w.word_idx) FILTER (w.word_idx < g.first) AS pre,
             string_agg(w.word, ' ' ORDER BY w.word_idx) FILTER (w.word_idx > g.last) AS suf
      FROM groups g JOIN words w USING (utt_id) GROUP BY ALL)
SELECT utt_id, group_no, CASE WHEN pre IS NULL THEN '' ELSE pre || ' ' END AS prefix,
       CASE WHEN suf IS NULL THEN '' ELSE ' ' || suf END AS suffix FROM c""")
def context_strings(spark, sf):
    return E.context_strings(B.words(spark, sf), groups(spark, sf)).select("utt_id", "group_no", "prefix", "suffix")
