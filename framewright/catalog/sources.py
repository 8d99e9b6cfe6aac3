"""Registered queries: sources and sinks (inventory section 2.1)."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from framewright.catalog.mixing import digest, sql_digest
from framewright.catalog.registry import query, r6
from framewright.operators.pool import summarize_pitch
from framewright.plans import bindings as B
from framewright.session import scratch_dir
from framewright.sources import binary as N
from framewright.sources import inputs as I
from framewright.sources import outputs as O


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_read_input_list", r"""SELECT doc_id, trim(l, E' \n\t\r') AS path FROM (
  SELECT doc_id, unnest(string_split(replace(text, 'The', '# The'), chr(10))) AS l FROM documents)
WHERE trim(l, E' \n\t\r') <> '' AND NOT starts_with(trim(l, E' \n\t\r'), '#')""")
def read_input_list(spark, sf):
    lines = B.table(spark, sf, "documents").select(
        "doc_id", F.explode(F.split(F.replace("text", F.lit("The"), F.lit("# The")), "\n")).alias("value"))
    return I.clean_input_lines(lines).withColumnRenamed("value", "path")


@query("S1_read_input_list_file", r"""SELECT path, count(*) AS n FROM (
  SELECT trim(l, E' \n\t\r') AS path FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents))
WHERE path <> '' AND NOT starts_with(path, '#') GROUP BY path""")
def read_input_list_file(spark, sf):
    path = _folder(spark, "list")
    B.table(spark, sf, "documents").select("text").write.text(path)
    return I.read_input_list(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("S2_collect_inputs", """WITH p AS (
  SELECT source || '/' || lang AS path, 0 AS s, doc_id AS pos FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT source || '/' || lang, 1, doc_id FROM documents WHERE doc_id % 3 = 1
  UNION ALL SELECT source || '/' || lang || '/' || (n_chars % 7), 2, doc_id FROM documents)
SELECT path, row_number() OVER (ORDER BY s, pos, path) - 1 AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, pos) AS k FROM p) WHERE k = 1""")
def collect_inputs(spark, sf):
    docs = B.table(spark, sf, "documents").withColumn("path", F.concat_ws("/", "source", "lang")) \
        .withColumn("pos", F.col("doc_id"))
    deep = docs.withColumn("path", F.concat_ws("/", "path", (F.col("n_chars") % 7).cast("string")))
    return I.collect_inputs([docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1"), deep])


@query("S3_scan_files", """SELECT source AS name, sum(strlen(text) + 1)::BIGINT AS length FROM documents GROUP BY source""")
def scan_files(spark, sf):
    """The texts of each source in one ``.txt`` file of its folder, beside files that the pattern leaves out."""
    folder = _folder(spark, "scanned")
    docs = B.table(spark, sf, "documents").select("source", "text").repartition("source")
    docs.write.partitionBy("source").text(folder)
    docs.write.mode("append").partitionBy("source").json(folder)
    found = I.scan_files(spark, folder, "*.txt", recursive=True)
    return found.select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("name"), "length")


def pack_floats(kind: str):
    @F.pandas_udf("binary")
    def pack(col: pd.Series) -> pd.Series:
        return col.map(lambda v: np.asarray(v, dtype=kind).tobytes())

    return pack


def _raw_sql(cols: int) -> str:
    return f"""SELECT vec_id, (i - 1) // {cols} AS frame, (i - 1) % {cols} AS col, {r6('embedding[i]::DOUBLE')} AS x
FROM (SELECT *, unnest(range(1, 65)) AS i FROM embeddings)"""


def _raw(spark, sf, endian):
    files = B.table(spark, sf, "embeddings").select(
        "vec_id", pack_floats("<f4" if endian == "little" else ">f4")("embedding").alias("content"))
    rows = I.decode_raw_matrix(files, 8, endian=endian)
    return rows.select("vec_id", F.col("frame").cast("bigint").alias("frame"), F.posexplode("values").alias("col", "x")).select(
        "vec_id", "frame", F.col("col").cast("bigint").alias("col"), B.r6(F.col("x")).alias("x"))


@query("S4_decode_raw_matrix", _raw_sql(8))
def raw_little(spark, sf):
    return _raw(spark, sf, "little")


@query("S4_decode_raw_matrix_big_endian", _raw_sql(8))
def raw_big(spark, sf):
    return _raw(spark, sf, "big")


@query("S4_read_matrix_ranges", f"""SELECT utt, frame, i - 1 AS col, {r6('embedding[i]::DOUBLE')} AS x FROM (
  SELECT label::VARCHAR AS utt, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, embedding, unnest(range(1, 65)) AS i FROM embeddings)""")
def read_matrix_ranges(spark, sf):
    """One big-endian file per label, read by several tasks each."""
    folder = _folder(spark, "matrices")
    rows = B.table(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    N.write_raw_matrices(rows, folder, "label", "vec_id", "embedding", endian="big").write.format("noop").mode("overwrite").save()
    got = N.read_matrix_ranges(spark, folder, 64, endian="big", pattern="*.ppg", split_bytes=1 << 15)
    return got.select("utt", "frame", F.posexplode("values").alias("col", "x")).select("utt", "frame", F.col("col").cast("bigint").alias("col"), B.r6(F.col("x")).alias("x"))


@query("S5_read_manifests", f"""WITH {B.MANIFEST}
SELECT 'A_' AS prefix, path, sentence, lang AS language FROM manifest WHERE doc_id % 2 = 0
UNION ALL SELECT 'B_', path, sentence, lang FROM manifest WHERE doc_id % 2 = 1""")
def read_manifests(spark, sf):
    rows = B.manifest(spark, sf).select("doc_id", "path", "sentence", F.col("lang").alias("language"))
    files = []
    for i, prefix in enumerate(("A_", "B_")):
        path = _folder(spark, f"manifest{i}")
        entry = F.to_json(F.struct("path", "sentence", "language"), {"pretty": "true"})
        arrays = rows.filter(F.col("doc_id") % 2 == i).groupBy(F.expr("doc_id div 200").alias("file")).agg(
            F.concat(F.lit("["), F.array_join(F.collect_list(entry), ",\n"), F.lit("]")).alias("value"))
        # Each manifest is one file that holds one array over many lines.
        arrays.write.partitionBy("file").text(path)
        files.append((path, prefix))
    return I.read_manifests(spark, files).select("prefix", "path", "sentence", "language")


@query("S6_read_transcripts", r"""SELECT source || '_' || lang || '_' || doc_id AS audio_id,
  'root/audio/' || source || '/' || lang || '/' || source || '_' || lang || '_' || doc_id || '.opus' AS path,
  trim(replace(text, chr(10), ' '), E' \n\t\r') AS sentence FROM documents WHERE trim(text, E' \n\t\r') <> ''""")
def read_transcripts(spark, sf):
    docs = B.table(spark, sf, "documents")
    key = F.concat_ws("_", "source", "lang", F.col("doc_id").cast("string"))
    lines = docs.select(F.concat(key, F.lit("\t"), F.ltrim(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("value"))
    folder = _folder(spark, "transcripts")
    lines.write.text(f"{folder}/transcripts.txt")
    read = I.read_transcripts(spark, folder)
    return read.withColumn("path", F.replace("path", F.lit(folder), F.lit("root")))


@query("S7_filelist_round_trip", f"""WITH {B.MANIFEST}
SELECT path, replace(sentence, chr(10), ' ') || '|' || speaker AS text FROM manifest""")
def filelist(spark, sf):
    rows = B.manifest(spark, sf).select("path", F.concat_ws(
        "|", F.replace("sentence", F.lit("\n"), F.lit(" ")), "speaker").alias("text"))
    path = _folder(spark, "filelist")
    O.write_filelist(rows, path)
    return I.read_filelist(spark, path)


@query("S8_attach_sidecar", f"""WITH {B.MANIFEST}
SELECT m.path, m.sentence, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic FROM (SELECT * FROM manifest ORDER BY path LIMIT 300) m
LEFT JOIN labels l USING (doc_id)""")
def attach_sidecar(spark, sf):
    utts = B.manifest(spark, sf).select("path", "sentence")
    meta = B.table(spark, sf, "labels").select(
        F.concat(F.lit("meta/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), "quality", "toxic")
    return I.attach_sidecar(utts, meta, 300).fillna(-1, ["quality", "toxic"])


@query("S9_load_pool", f"""WITH {B.FRAMES}, {B.POOL}, {B.POOL_PITCH}
SELECT p.speaker_id::VARCHAR AS speaker_id, p.gender, p.cluster, {r6('m')} AS m, {r6('s')} AS s, w::DOUBLE AS w, {sql_digest('p.xvector')}
FROM pool p JOIN pool_pitch q USING (speaker_id)""")
def load_pool(spark, sf):
    pool = B.pool(spark, sf).withColumn("speaker_id", F.col("speaker_id").cast("string"))
    genders = I.parse_speaker_genders(pool.select(F.concat_ws(" ", "speaker_id", "gender").alias("value")))
    summary = summarize_pitch(B.raw_pitch(spark, sf))
    maps = summary.select(F.to_json(F.create_map(
        F.col("speaker_id").cast("string"), F.array("m", "s", F.col("w").cast("double")))).alias("value"))
    out = I.load_pool(genders, I.assert_same_dim(pool), pool, I.parse_pool_pitch(maps))
    return out.select("speaker_id", "gender", "cluster", B.r6(F.col("m")).alias("m"), B.r6(F.col("s")).alias("s"),
                      "w", *digest(F.col("xvector")))


@query("S10_vector_dims", "SELECT len(embedding) AS dim, count(*) AS n FROM embeddings GROUP BY 1")
def vector_dims(spark, sf):
    return I.vector_dims(B.pool(spark, sf)).select(F.col("dim").cast("bigint").alias("dim"), "n")


@query("S11_write_results", f"""WITH {B.MANIFEST}
SELECT doc_id, CASE WHEN speaker IN ('src1', 'src2') THEN seconds * 2 ELSE seconds END AS seconds, speaker FROM manifest""")
def write_results(spark, sf):
    rows = B.manifest(spark, sf).select("doc_id", "seconds", "speaker")
    path = _folder(spark, "results")
    O.write_results(rows, path, "speaker")
    O.write_results(rows.filter("speaker in ('src1', 'src2')").withColumn("seconds", F.col("seconds") * 2), path, "speaker")
    return O.read_results(spark, path).select("doc_id", "seconds", "speaker")


@query("S12_payload_round_trip", f"""WITH {B.VECTORS}
SELECT utt_id, frame, {sql_digest('vec')} FROM va""")
def payload(spark, sf):
    path = _folder(spark, "payload")
    O.write_payload(B.vectors(spark, sf), path)
    return O.read_payload(spark, path).select("utt_id", "frame", *digest(F.col("vec")))


@query("S13_missing_files", """SELECT n_nationkey AS path FROM nation
WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def missing_files(spark, sf):
    nation = B.table(spark, sf, "nation").select(F.col("n_nationkey").alias("path"))
    present = B.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("path"))
    return I.missing_files(nation, present)


@query("S14_verify_checksums", """SELECT doc_id AS path, CASE WHEN doc_id % 11 = 3 THEN 'missing'
  WHEN sha256(text) = sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) THEN 'ok' ELSE 'mismatch' END AS status,
  sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS digest FROM documents""")
def verify_checksums(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    changed = F.when(F.col("path") % 10 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content"))
    sums = docs.select("path", I.digest(changed).alias("digest"))
    return I.verify_checksums(docs.filter("path % 11 <> 3"), sums).join(sums, "path")


@query("S14_digest_files", """SELECT source AS name, sum(strlen(text) + 1)::BIGINT AS length, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest,
  CASE WHEN source LIKE '%1%' THEN 'mismatch' ELSE 'ok' END AS status FROM documents GROUP BY source""")
def digest_files(spark, sf):
    """The files of a folder are hashed in pieces and compared with a manifest that is wrong for some."""
    folder = _folder(spark, "hashed")
    docs = B.table(spark, sf, "documents").select("source", "doc_id", "text")
    docs.repartition("source").sortWithinPartitions("source", "doc_id").drop("doc_id").write.partitionBy("source").text(folder)
    found = N.digest_files(spark, folder, "*.txt", recursive=True).withColumn("name", F.regexp_extract("path", "source=([^/]+)/", 1))
    sums = found.select("path", F.when(F.col("name").contains("1"), F.lit("0")).otherwise(F.col("digest")).alias("digest"))
    return found.join(I.verify_checksums(found, sums), "path").select("name", "length", "digest", "status")


@query("S15_write_report", """SELECT '| timing ' || user_id || ' | ' || CASE WHEN count(*) > 66 THEN 'PASS' ELSE 'WARN' END || ' | '
  || count(*) || ' rows | first=' || min(event_id) || ', last=' || max(event_id) || ' |' AS line, user_id FROM events GROUP BY user_id""")
def write_report(spark, sf):
    timings = B.timings(spark, sf)
    checks = timings.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("lo"), F.max("row_id").alias("hi")).select(
        F.concat(F.lit("timing "), F.col("file").cast("string")).alias("check"),
        F.when(F.col("n") > 66, "PASS").otherwise("WARN").alias("status"),
        F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"),
        F.create_map(F.lit("first"), F.col("lo").cast("string"), F.lit("last"), F.col("hi").cast("string")).alias("metrics"))
    path = _folder(spark, "report")
    O.write_report(checks, timings, path)
    lines = spark.read.text(f"{path}/markdown")
    return lines.select(F.col("value").alias("line"), F.regexp_extract("value", r"timing (\d+)", 1).cast("bigint").alias("user_id"))
