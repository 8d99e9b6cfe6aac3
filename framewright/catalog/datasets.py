"""Registered queries: dataset preparation (inventory section 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.catalog.registry import query
from framewright.operators import corpus as C
from framewright.operators import datasets as D
from framewright.plans import bindings as B

_M = f"WITH {B.MANIFEST}"


def _paths(spark, sf):
    return B.manifest(spark, sf).select("doc_id", "path")


@query("D1_split_ordered", f"""{_M}, n AS (SELECT doc_id, path, row_number() OVER (ORDER BY path) - 1 AS no,
  floor(count(*) OVER () * 0.9) AS cut FROM manifest)
SELECT doc_id, path, CASE WHEN no < cut THEN 'train' ELSE 'valid' END AS split FROM n
WHERE (no < cut AND no < 150) OR (no >= cut AND no - cut < 15)""")
def split_ordered(spark, sf):
    return D.split_ordered(_paths(spark, sf), ["path"], 0.9, 150, 15)


@query("D2_split_random", f"""{_M}, n AS (SELECT doc_id, path, row_number() OVER (ORDER BY md5('42:' || path), path) - 1 AS no,
  floor(count(*) OVER () * 0.9) AS cut FROM manifest)
SELECT doc_id, path, CASE WHEN no < cut THEN 'train' ELSE 'valid' END AS split FROM n""")
def split_random(spark, sf):
    return D.split_random(_paths(spark, sf), "path", 0.9, 42)


@query("D2_split_random_capped", f"""{_M}, n AS (SELECT doc_id, path, row_number() OVER (ORDER BY md5('42:' || path), path) - 1 AS no,
  floor(count(*) OVER () * 0.9) AS cut FROM manifest)
SELECT doc_id, path, CASE WHEN no < cut THEN 'train' ELSE 'valid' END AS split FROM n WHERE no < cut OR no - cut < 256""")
def split_random_capped(spark, sf):
    return D.split_random(_paths(spark, sf), "path", 0.9, 42, 256)


@query("D3_combine", f"""{_M}, u AS (SELECT doc_id, path, doc_id % 3 AS dataset FROM manifest),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY path) - 1 AS row FROM u),
i AS (SELECT *, row_number() OVER (ORDER BY dataset, row) - 1 AS "index" FROM r)
SELECT doc_id, path, dataset, row, "index", row_number() OVER (ORDER BY md5('5:' || "index"), "index") - 1 AS place FROM i""")
def combine(spark, sf):
    rows = _paths(spark, sf)
    out = D.combine([rows.filter(F.col("doc_id") % 3 == i) for i in range(3)], "path", 5)
    return out.withColumn("dataset", F.col("dataset").cast("bigint"))


@query("D4_subsample", f"""{_M} SELECT doc_id, path FROM (SELECT *, row_number() OVER (ORDER BY path) - 1 AS no FROM manifest) WHERE no % 50 = 0""")
def subsample(spark, sf):
    return D.subsample(_paths(spark, sf), ["path"], 50)


@query("D5_holdout", f"""{_M} SELECT doc_id, path, CASE WHEN no % 30 = 0 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY path) - 1 AS no FROM manifest)""")
def holdout(spark, sf):
    return D.holdout(_paths(spark, sf), ["path"], 30)


def _modalities(spark, sf):
    return D.pair_modalities({
        "text": B.manifest(spark, sf).select(F.col("doc_id").alias("id"), "path"),
        "label": B.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"),
        "vector": B.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label")}, "id")


@query("D6_pair_modalities", f"""{_M} SELECT m.doc_id AS id, m.path, l.quality, e.label FROM manifest m
JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = m.doc_id""")
def pair(spark, sf):
    return _modalities(spark, sf)[0]


@query("D6_pair_modalities_report", """SELECT id, concat_ws(',', CASE WHEN d.doc_id IS NULL THEN 'text' END,
  CASE WHEN l.doc_id IS NULL THEN 'label' END, CASE WHEN e.vec_id IS NULL THEN 'vector' END) AS missing
FROM (SELECT doc_id AS id FROM documents UNION SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings) k
LEFT JOIN documents d ON d.doc_id = id LEFT JOIN labels l ON l.doc_id = id LEFT JOIN embeddings e ON e.vec_id = id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL OR e.vec_id IS NULL""")
def pair_report(spark, sf):
    return _modalities(spark, sf)[1].select("id", F.array_join("missing", ",").alias("missing"))


@query("D7_limit_rows", f"{_M} SELECT doc_id, path FROM manifest ORDER BY path LIMIT 100")
def limit_rows(spark, sf):
    return D.limit_rows(_paths(spark, sf), ["path"], 100)


@query("D8_truncate_pair", r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS a,
  list_transform(range(0, (doc_id % 97)::BIGINT), lambda i: (i * doc_id)) AS b FROM documents)
SELECT doc_id, array_to_string(a[1:least(len(a), len(b))], ' ') AS a, array_to_string(b[1:least(len(a), len(b))], ' ') AS b FROM t""")
def truncate_pair(spark, sf):
    n = (F.col("doc_id") % 97).cast("int")
    rows = B.table(spark, sf, "documents").select(
        "doc_id", B.split_words(F.col("text")).alias("a"),
        F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.col("doc_id"))).otherwise(
            F.array().cast("array<bigint>")).alias("b"))
    return D.truncate_pair(rows, "a", "b").select("doc_id", F.array_join("a", " ").alias("a"), F.array_join("b", " ").alias("b"))


@query("D9_round_robin", f"{_M} SELECT doc_id, path, (row_number() OVER (ORDER BY path) - 1) % 4 AS bucket FROM manifest")
def round_robin(spark, sf):
    return D.round_robin(_paths(spark, sf), ["path"], 4)


_SCORED = f"""{_M}, scored AS (SELECT m.doc_id, m.speaker, m.seconds, l.quality * 2 + m.doc_id % 4 AS score
  FROM manifest m JOIN labels l USING (doc_id))"""


def scored(spark, sf):
    return B.manifest(spark, sf).join(B.table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "speaker", "seconds", (F.col("quality") * 2 + F.col("doc_id") % 4).alias("score"))


@query("D10_quota_filter", f"""{_SCORED}
SELECT doc_id, speaker, score FROM (SELECT *, sum(seconds) OVER (PARTITION BY speaker ORDER BY doc_id) AS total
  FROM scored WHERE score > 2.3) WHERE total <= 600""")
def quota(spark, sf):
    return D.quota_filter(scored(spark, sf), "speaker", "doc_id", "seconds", "score", 2.3, 600.0).select("doc_id", "speaker", "score")


@query("D10_speaker_band", f"""{_SCORED}
SELECT doc_id, speaker FROM scored WHERE speaker IN (
  SELECT speaker FROM scored GROUP BY speaker HAVING sum(seconds) BETWEEN 600 AND 4000)""")
def band(spark, sf):
    return D.speaker_band(scored(spark, sf), "speaker", "seconds", 600.0, 4000.0).select("doc_id", "speaker")


@query("D11_route_language", """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' END AS route,
  CASE WHEN lang NOT IN ('en', 'fr') THEN 'Language ' || lang || ' not supported' END AS error FROM documents""")
def route(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", "lang")
    return C.route_language(docs, {"en": "english", "fr": "french"}).select("doc_id", "route", "error")
