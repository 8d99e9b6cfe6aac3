"""Registered queries: residual codes, vectors and mixing (inventory section 2.5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query, r6, sql_uniform
from framewright.functions.vectors import cosine
from framewright.operators import mixing as M
from framewright.plans import bindings as B


def digest(vec):
    """Three numbers that depend on every entry: first, last and position-weighted sum."""
    weighted = F.aggregate(
        F.transform(vec, lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return [B.r6(vec[0]).alias("first"), B.r6(F.element_at(vec, -1)).alias("last"),
            B.r6(weighted).alias("weighted")]


def sql_digest(vec: str) -> str:
    return (f"{r6(f'{vec}[1]')} AS first, {r6(f'{vec}[-1]')} AS last, "
            f"{r6(f'list_sum(list_transform({vec}, lambda x, i: x * i))')} AS weighted")


def sql_unit(v: str) -> str:
    mean = f"list_sum({v}) / len({v})"
    return f"list_transform({v}, lambda x: (x - {mean}) / sqrt(list_sum(list_transform({v}, lambda y: (y - {mean}) * (y - {mean})))))"


_VSUM = ("list_transform(range(1, len(b0.vec) + 1), "
         "lambda i: b0.vec[i] + b1.vec[i] + b2.vec[i] + b3.vec[i])")
_DECODED = f"""decoded AS (
  SELECT c.utt_id, c.frame, {_VSUM} AS vec FROM codes c
  JOIN codebook b0 ON b0.q = 0 AND b0.code = c.c0 JOIN codebook b1 ON b1.q = 1 AND b1.code = c.c1
  JOIN codebook b2 ON b2.q = 2 AND b2.code = c.c2 JOIN codebook b3 ON b3.q = 3 AND b3.code = c.c3)"""


@query("V1_rvq_decode", f"""WITH {B.FRAMES}, {B.CODES_SQL}, {B.CODEBOOK}, {_DECODED}
SELECT utt_id, frame, {sql_digest('vec')} FROM decoded""")
def decode(spark, sf):
    out = M.rvq_decode(B.codes(spark, sf), B.codebook(spark, sf), B.LEVELS)
    return out.filter("vec is not null").select("utt_id", "frame", *digest(F.col("vec")))


def _encode_sql() -> str:
    parts = [f"WITH {B.VECTORS}, {B.CODEBOOK}, r0 AS (SELECT utt_id, frame, vec FROM va)"]
    for q in range(B.LEVELS):
        parts.append(f"""n{q} AS (
  SELECT r.utt_id, r.frame, arg_min(c.code, {{d}}) AS c{q}
  FROM r{q} r JOIN codebook c ON c.q = {q} GROUP BY r.utt_id, r.frame),
r{q + 1} AS (SELECT r.utt_id, r.frame, list_transform(range(1, 65), lambda i: r.vec[i] - c.vec[i]) AS vec
  FROM r{q} r JOIN n{q} n USING (utt_id, frame) JOIN codebook c ON c.q = {q} AND c.code = n.c{q})""".replace(
            "{d}", "list_distance(r.vec, c.vec)"))
    return ",\n".join(parts) + """
SELECT utt_id, frame, c0, c1, c2, c3 FROM n0 JOIN n1 USING (utt_id, frame)
JOIN n2 USING (utt_id, frame) JOIN n3 USING (utt_id, frame)"""


@query("V2_rvq_encode", _encode_sql())
def encode(spark, sf):
    out = M.rvq_encode(B.vectors(spark, sf).select("utt_id", "frame", "vec"), B.codebook(spark, sf), B.LEVELS)
    return out.select("utt_id", "frame", *[F.col("codes")[q].cast("bigint").alias(f"c{q}") for q in range(B.LEVELS)])


@query("V3_assign_clusters", f"""WITH {B.VECTORS},
c AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id % 25 = 0)
SELECT va.vec_id, arg_min(c.id, list_distance(va.vec, c.vec)) AS cluster
FROM va CROSS JOIN c GROUP BY va.vec_id""")
def assign(spark, sf):
    vecs = B.vectors(spark, sf)
    centres = vecs.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("id"), "vec")
    return M.assign_clusters(vecs, centres).select("vec_id", "cluster")


def _lloyd_sql(levels: int = 2, steps: int = 3) -> str:
    parts = [f"""WITH {B.VECTORS}, r0 AS (SELECT vec_id, vec FROM va),
start AS (SELECT (vec_id // 8)::INT AS q, vec_id % 8 AS code, embedding::DOUBLE[] AS vec FROM embeddings WHERE vec_id < {8 * levels})"""]
    for q in range(levels):
        parts.append(f"c{q}_0 AS (SELECT code, vec, 0 AS n FROM start WHERE q = {q})")
        for t in range(steps):
            parts.append(f"""a{q}_{t} AS (SELECT r.vec_id, arg_min(c.code, list_distance(r.vec, c.vec)) AS code FROM r{q} r CROSS JOIN c{q}_{t} c GROUP BY r.vec_id),
m{q}_{t} AS (SELECT code, list(x ORDER BY i) AS vec FROM (SELECT code, i, avg(vec[i]) AS x FROM (
  SELECT code, vec, unnest(range(1, 65)) AS i FROM r{q} JOIN a{q}_{t} USING (vec_id)) GROUP BY code, i) GROUP BY code),
c{q}_{t + 1} AS (SELECT c.code, coalesce(m.vec, c.vec) AS vec, (SELECT count(*) FROM a{q}_{t} a WHERE a.code = c.code) AS n
  FROM c{q}_{t} c LEFT JOIN m{q}_{t} m USING (code))""")
        parts.append(f"""e{q} AS (SELECT r.vec_id, arg_min(c.code, list_distance(r.vec, c.vec)) AS code FROM r{q} r CROSS JOIN c{q}_{steps} c GROUP BY r.vec_id),
r{q + 1} AS (SELECT r.vec_id, list_transform(range(1, 65), lambda i: r.vec[i] - c.vec[i]) AS vec
  FROM r{q} r JOIN e{q} USING (vec_id) JOIN c{q}_{steps} c USING (code))""")
    return ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT {q} AS q, code, n, {sql_digest('vec')} FROM c{q}_{steps}" for q in range(levels))


@query("V4_lloyd_steps", _lloyd_sql())
def lloyd(spark, sf):
    vecs = B.vectors(spark, sf)
    first = vecs.filter("vec_id < 16").select(F.expr("cast(vec_id div 8 as int)").alias("q"), (F.col("vec_id") % 8).alias("code"), "vec")
    return M.lloyd_steps(vecs, first, 2, 3).select("q", "code", "n", *digest(F.col("vec")))


@query("V4_fit_codebook")
def fit(spark, sf):
    book = M.fit_codebook(B.vectors(spark, sf), k=8, levels=2, seed=11)
    return book.select("q", "code", *digest(F.col("vec")))


_SHIFTED = """orig AS (SELECT utt_id, frame, (c0 + 1) % 16 AS c0, (c1 + 2) % 16 AS c1,
  (c2 + 3) % 16 AS c2, (c3 + 4) % 16 AS c3 FROM codes),
syn AS (SELECT utt_id, frame, c0, c1, CASE WHEN utt_id % 3 = 0 AND frame = 5 THEN -1 ELSE c2 END AS c2, c3 FROM codes)"""


def _shifted_codes(spark, sf):
    codes = B.codes(spark, sf)
    orig = codes.withColumn("codes", F.transform("codes", lambda c, i: ((c + i + 1) % 16).cast("int")))
    hole = (F.col("utt_id") % 3 == 0) & (F.col("frame") == 5)
    syn = codes.withColumn("codes", F.transform(
        "codes", lambda c, i: F.when(hole & (i == 2), -1).otherwise(c)))
    return syn, orig


@query("V5_repair_columns", f"""WITH {B.FRAMES}, {B.CODES_SQL}, {_SHIFTED},
h AS (SELECT utt_id, bool_or(c0 = 1024) AS hit, bool_or(c0 IN (1024, -1)) AS h0, bool_or(c1 IN (1024, -1)) AS h1,
             bool_or(c2 IN (1024, -1)) AS h2, bool_or(c3 IN (1024, -1)) AS h3 FROM syn GROUP BY utt_id)
SELECT s.utt_id, s.frame, CASE WHEN hit AND h0 THEN o.c0 ELSE s.c0 END AS c0,
  CASE WHEN hit AND h1 THEN o.c1 ELSE s.c1 END AS c1, CASE WHEN hit AND h2 THEN o.c2 ELSE s.c2 END AS c2,
  CASE WHEN hit AND h3 THEN o.c3 ELSE s.c3 END AS c3
FROM syn s JOIN orig o USING (utt_id, frame) JOIN h USING (utt_id)""")
def repair(spark, sf):
    syn, orig = _shifted_codes(spark, sf)
    out = M.repair_columns(syn, orig, B.LEVELS)
    return out.select("utt_id", "frame", *[F.col("codes")[q].cast("bigint").alias(f"c{q}") for q in range(B.LEVELS)])


_CORR = f"""ua AS (SELECT utt_id, frame, {sql_unit('vec')} AS u FROM va),
ub AS (SELECT utt_id, frame, {sql_unit('vec')} AS u FROM vb),
corr AS (SELECT b.utt_id, b.frame, max(list_dot_product(b.u, a.u)) AS corr
  FROM ub b JOIN ua a ON a.utt_id = b.utt_id AND a.frame BETWEEN b.frame - 2 AND b.frame + 2 {{extra}}
  GROUP BY b.utt_id, b.frame)"""


@query("V6_windowed_corr", f"""WITH {B.VECTORS}, {_CORR.format(extra='')}
SELECT utt_id, frame, {r6('corr')} AS corr FROM corr""")
def corr(spark, sf):
    out = M.windowed_corr(B.vectors_b(spark, sf), B.vectors(spark, sf))
    return out.select("utt_id", "frame", B.r6(F.col("corr")).alias("corr"))


@query("V6_windowed_corr_unrelated_streams", f"""WITH {B.VECTORS},
vc AS (SELECT utt_id + 1 AS utt_id, frame, vec FROM va), {_CORR.format(extra='').replace('FROM vb', 'FROM vc').replace(
    'GROUP BY', "WHERE a.frame <= (SELECT max(frame) FROM vc WHERE vc.utt_id = a.utt_id) AND b.frame <= (SELECT max(frame) FROM va WHERE va.utt_id = b.utt_id) GROUP BY")}
SELECT utt_id, frame, {r6('corr')} AS corr FROM corr""")
def corr_unrelated(spark, sf):
    vecs = B.vectors(spark, sf).select("utt_id", "frame", "vec")
    other = vecs.withColumn("utt_id", F.col("utt_id") + 1)
    out = M.windowed_corr(other, vecs)
    return out.filter("corr is not null").select("utt_id", "frame", B.r6(F.col("corr")).alias("corr"))


@query("V7_admix", f"""WITH {B.VECTORS},
m AS (SELECT a.utt_id, a.frame, {sql_uniform("'52:' || a.utt_id || ':' || a.frame")} <= 0.7 AS from_syn,
             a.vec AS av, b.vec AS bv FROM va a JOIN vb b USING (utt_id, frame))
SELECT utt_id, frame, from_syn, {sql_digest('(CASE WHEN from_syn THEN bv ELSE av END)')} FROM m""")
def admix(spark, sf):
    out = M.admix(B.vectors(spark, sf).select("utt_id", "frame", "vec"), B.vectors_b(spark, sf), 0.7, 52)
    return out.select("utt_id", "frame", "from_syn", *digest(F.col("vec")))


@query("V7_admix_gated", f"""WITH {B.VECTORS}, {_CORR.format(extra='').replace(
    'BETWEEN b.frame - 2 AND b.frame + 2', '= b.frame')},
m AS (SELECT a.utt_id, a.frame, {sql_uniform("'52:' || a.utt_id || ':' || a.frame")} <= 0.7 AND NOT (c.corr < 0.05) AS from_syn,
             a.vec AS av, b.vec AS bv, c.corr FROM va a JOIN vb b USING (utt_id, frame) JOIN corr c USING (utt_id, frame))
SELECT utt_id, frame, from_syn, {r6('corr')} AS corr, {sql_digest('(CASE WHEN from_syn THEN bv ELSE av END)')} FROM m""")
def admix_gated(spark, sf):
    a, b = B.vectors(spark, sf).select("utt_id", "frame", "vec"), B.vectors_b(spark, sf)
    out = M.admix(a, b, 0.7, 52, corr=M.windowed_corr(b, a, max_shift=0), tau=0.05)
    return out.select("utt_id", "frame", "from_syn", B.r6(F.col("corr")).alias("corr"), *digest(F.col("vec")))


@query("V7_admix_default_gate_unrelated_streams", f"""WITH {B.VECTORS}, ends AS (SELECT utt_id, max(frame) AS last FROM va GROUP BY utt_id),
vc AS (SELECT utt_id, last - frame AS frame, vec FROM va JOIN ends USING (utt_id)),
ua AS (SELECT utt_id, frame, {sql_unit('vec')} AS u FROM va), ub AS (SELECT utt_id, frame, {sql_unit('vec')} AS u FROM vc),
corr AS (SELECT b.utt_id, b.frame, max(list_dot_product(b.u, a.u)) AS corr
  FROM ub b JOIN ua a ON a.utt_id = b.utt_id AND a.frame BETWEEN b.frame - 2 AND b.frame + 2 GROUP BY b.utt_id, b.frame),
m AS (SELECT a.utt_id, a.frame, {sql_uniform("'52:' || a.utt_id || ':' || a.frame")} <= 0.7 AND NOT (c.corr < 0.6) AS from_syn,
             a.vec AS av, b.vec AS bv FROM va a JOIN vc b USING (utt_id, frame) JOIN corr c USING (utt_id, frame))
SELECT utt_id, frame, from_syn, {sql_digest('(CASE WHEN from_syn THEN bv ELSE av END)')} FROM m""")
def admix_default_gate(spark, sf):
    """The other stream is the same recording backwards, so only frames near its middle resemble each other."""
    a = B.vectors(spark, sf).select("utt_id", "frame", "vec")
    last = a.groupBy("utt_id").agg(F.max("frame").alias("last"))
    b = a.join(last, "utt_id").select("utt_id", (F.col("last") - F.col("frame")).alias("frame"), "vec")
    out = M.admix(a, b, 0.7, 52, corr=M.windowed_corr(b, a))
    return out.select("utt_id", "frame", "from_syn", *digest(F.col("vec")))


@query("V8_assemble_frames", f"""WITH {B.FRAMES}, {B.CODES_SQL}, {B.POOL}
SELECT c.utt_id, c.frame, {sql_digest('list_concat([c0, c1, c2, c3]::DOUBLE[], [f.f0], p.xvector)')}
FROM codes c JOIN frames f USING (utt_id, frame) JOIN pool p ON p.speaker_id = c.utt_id""")
def assemble(spark, sf):
    """Every frame of every recording; the codes of a frame stand for its vector."""
    speaker = B.pool(spark, sf).select(F.col("speaker_id").alias("utt_id"), "xvector")
    vecs = B.codes(spark, sf).select("utt_id", "frame", F.transform("codes", lambda c: c.cast("double")).alias("vec"))
    out = M.assemble_frames(vecs, B.frames(spark, sf), speaker)
    return out.select("utt_id", "frame", *digest(F.col("input")))


@query("V9_cosine", f"""WITH {B.VECTORS}
SELECT a.utt_id, a.frame, {r6('list_cosine_similarity(a.vec, b.vec)')} AS similarity
FROM va a JOIN vb b USING (utt_id, frame)""")
def keyed_cosine(spark, sf):
    out = M.keyed_cosine(B.vectors(spark, sf), B.vectors_b(spark, sf), ["utt_id", "frame"])
    return out.withColumn("similarity", B.r6(F.col("similarity")))


def _level_sql() -> str:
    sums = ["b0.vec[i]", "b0.vec[i] + b1.vec[i]", "b0.vec[i] + b1.vec[i] + b2.vec[i]",
            "b0.vec[i] + b1.vec[i] + b2.vec[i] + b3.vec[i]"]
    cols = ", ".join(
        f"avg(list_cosine_similarity(v.vec, list_transform(range(1, 65), lambda i: {s}))) AS s{q}"
        for q, s in enumerate(sums))
    return f"""{_encode_sql().rsplit('SELECT utt_id, frame, c0', 1)[0]},
c AS (SELECT utt_id, frame, c0, c1, c2, c3 FROM n0 JOIN n1 USING (utt_id, frame)
      JOIN n2 USING (utt_id, frame) JOIN n3 USING (utt_id, frame)),
s AS (SELECT v.utt_id, {cols} FROM va v JOIN c USING (utt_id, frame)
      JOIN codebook b0 ON b0.q = 0 AND b0.code = c0 JOIN codebook b1 ON b1.q = 1 AND b1.code = c1
      JOIN codebook b2 ON b2.q = 2 AND b2.code = c2 JOIN codebook b3 ON b3.q = 3 AND b3.code = c3 GROUP BY v.utt_id)
""" + " UNION ALL ".join(f"SELECT {q} AS level, {r6(f'avg(s{q})')} AS similarity FROM s" for q in range(4))


@query("V10_rvq_level_similarity", _level_sql())
def level_similarity(spark, sf):
    vecs, book = B.vectors(spark, sf).select("utt_id", "frame", "vec"), B.codebook(spark, sf)
    out = M.rvq_level_similarity(vecs, M.rvq_encode(vecs, book, B.LEVELS), book, B.LEVELS)
    return out.select("level", B.r6(F.col("similarity")).alias("similarity"))


@query("V11_mean_vector", f"""WITH {B.VECTORS}
SELECT utt_id, i - 1 AS dim, {r6('avg(vec[i])')} AS x
FROM (SELECT utt_id, vec, unnest(range(1, 65)) AS i FROM va) GROUP BY utt_id, i""")
def mean_vector(spark, sf):
    out = M.mean_vector(B.vectors(spark, sf), "utt_id")
    return out.select("utt_id", F.posexplode("vec").alias("dim", "x")).select(
        "utt_id", F.col("dim").cast("bigint").alias("dim"), B.r6(F.col("x")).alias("x"))


def _pack_sql(pad: bool) -> str:
    bound = "max" if pad else "min"
    out = ("list_concat(lens, list_transform(range(0, target - length), lambda x: 0::BIGINT))" if pad
           else "lens[1:target]")
    return rf"""WITH w AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> ''),
                                lambda x: length(x)) AS lens FROM documents),
n AS (SELECT *, len(lens) AS length, row_number() OVER (ORDER BY len(lens) DESC, doc_id) - 1 AS no FROM w),
b AS (SELECT *, no // 32 AS batch, no % 32 AS slot, {bound}(length) OVER (PARTITION BY no // 32) AS target FROM n)
SELECT doc_id, batch, slot, length, len({out}) AS padded, md5(array_to_string({out}, ' ')) AS content FROM b"""


def _pack(spark, sf, mode):
    docs = B.table(spark, sf, "documents").select(
        "doc_id", F.transform(B.split_words(F.col("text")), lambda x: F.length(x)).alias("lens"))
    out = M.pack_batches(docs, "doc_id", "lens", 32, mode)
    return out.select("doc_id", "batch", "slot", F.col("length").cast("bigint").alias("length"),
                      F.size("lens").cast("bigint").alias("padded"),
                      F.md5(F.array_join("lens", " ")).alias("content"))


@query("V12_pack_batches_pad", _pack_sql(True))
def pack_pad(spark, sf):
    return _pack(spark, sf, "pad")


@query("V12_pack_batches_cut", _pack_sql(False))
def pack_cut(spark, sf):
    return _pack(spark, sf, "cut")
