"""The library's input shapes read from the test tables, in Spark and as SQL.

``FIXTURES.md`` section 3 defines them. Tables that need numbering are written
once per session and folder (see ``session.materialize``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators.scans import number_rows, running_sum, with_lag_lead
from framewright.session import materialize

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a table of few file splits to all cores; larger tables keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _once(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(build(), name)
    return _WRITTEN[key]


def r6(col: Column) -> Column:
    """Six digits; the nudge keeps exact ties from depending on the engine's rounding."""
    return F.round(col + 1e-9, 6)


def r4(col: Column) -> Column:
    return F.round(col + 1e-7, 4)


# ---------------------------------------------------------------- frames


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, frame, f0, event_id, event_type; one recording per user."""

    def build():
        events = table(spark, sf, "events").select(
            F.col("user_id").alias("utt_id"), "ts", "event_id", "event_type", "value")
        return number_rows(events, ["ts", "event_id"], ["utt_id"], out="frame").select(
            "utt_id", "frame",
            F.when(F.col("event_type") == "error", 0.0).otherwise(50 + F.col("value")).alias("f0"),
            "event_id", "event_type")

    return _once(spark, sf, "frames", build)


def second_f0(spark: SparkSession, sf: str) -> DataFrame:
    """The F0 series shifted by one frame, one frame shorter."""
    shifted = with_lag_lead(frames(spark, sf).select("utt_id", "frame", "f0"), "utt_id",
                            lead={"f0b": "f0"})
    return shifted.filter("f0b is not null").select("utt_id", "frame", F.col("f0b").alias("f0"))


FRAMES = """frames AS (
  SELECT user_id AS utt_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
         CASE WHEN event_type = 'error' THEN 0.0 ELSE 50 + value END AS f0,
         event_id, event_type
  FROM events)"""
SECOND_F0 = """second_f0 AS (
  SELECT utt_id, frame, f0 FROM (
    SELECT utt_id, frame, lead(f0) OVER (PARTITION BY utt_id ORDER BY frame) AS f0 FROM frames)
  WHERE f0 IS NOT NULL)"""

# ---------------------------------------------------------------- codes and vectors

LEVELS, CODES, EOS = 4, 16, 1024


def codes(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, frame, codes[4]; the end marker sits in level 0 of some sign-up frames."""
    base = frames(spark, sf)
    levels = [((F.col("event_id") * (2 * q + 1) + q) % CODES).cast("int") for q in range(LEVELS)]
    levels[0] = F.when(
        (F.col("event_type") == "signup") & (F.col("frame") % 17 == 0), F.lit(EOS)).otherwise(levels[0])
    return base.select("utt_id", "frame", F.array(*levels).alias("codes"))


CODES_SQL = """codes AS (
  SELECT utt_id, frame,
         CASE WHEN event_type = 'signup' AND frame % 17 = 0 THEN 1024 ELSE event_id % 16 END AS c0,
         (event_id * 3 + 1) % 16 AS c1, (event_id * 5 + 2) % 16 AS c2, (event_id * 7 + 3) % 16 AS c3
  FROM frames)"""


def codebook(spark: SparkSession, sf: str) -> DataFrame:
    """q, code, vec: four levels of sixteen vectors."""
    vecs = table(spark, sf, "embeddings").filter(F.col("vec_id") < LEVELS * CODES)
    return vecs.select(
        F.expr(f"cast(vec_id div {CODES} as int)").alias("q"),
        (F.col("vec_id") % CODES).cast("int").alias("code"),
        F.col("embedding").cast("array<double>").alias("vec"))


CODEBOOK = """codebook AS (
  SELECT vec_id // 16 AS q, vec_id % 16 AS code, embedding::DOUBLE[] AS vec
  FROM embeddings WHERE vec_id < 64)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Stream A: utt_id, frame, vec, vec_id; one recording per label."""

    def build():
        rows = table(spark, sf, "embeddings").select(
            F.col("label").cast("bigint").alias("utt_id"), "vec_id",
            F.col("embedding").cast("array<double>").alias("vec"))
        return number_rows(rows, ["vec_id"], ["utt_id"], out="frame").select(
            "utt_id", "frame", "vec", "vec_id")

    return _once(spark, sf, "vectors", build)


def vectors_b(spark: SparkSession, sf: str) -> DataFrame:
    """Stream B: the vector of the next frame, the own one at the end."""
    shifted = with_lag_lead(vectors(spark, sf), "utt_id", lead={"nxt": "vec"})
    return shifted.select("utt_id", "frame", F.coalesce("nxt", "vec").alias("vec"))


VECTORS = """va AS (
  SELECT label::BIGINT AS utt_id, vec_id,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
         embedding::DOUBLE[] AS vec
  FROM embeddings),
vb AS (
  SELECT utt_id, frame,
         coalesce(lead(vec) OVER (PARTITION BY utt_id ORDER BY frame), vec) AS vec FROM va)"""

# ---------------------------------------------------------------- speaker pool


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """speaker_id, ord, gender, cluster, xvector."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("speaker_id"), F.col("vec_id").alias("ord"),
        F.when(F.col("vec_id") % 2 == 0, "f").otherwise("m").alias("gender"),
        F.col("label").cast("bigint").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("xvector"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """cluster, centre_speaker, n_speakers, density_pos (ascending density)."""
    def build():
        grouped = pool(spark, sf).groupBy("cluster").agg(
            F.min("speaker_id").alias("centre_speaker"), F.count(F.lit(1)).alias("n_speakers"))
        return number_rows(grouped, ["n_speakers", "cluster"], out="density_pos")

    return _once(spark, sf, "clusters", build)


def raw_pitch(spark: SparkSession, sf: str) -> DataFrame:
    """speaker_id, idx, f0."""
    return frames(spark, sf).select(
        F.col("utt_id").alias("speaker_id"), F.col("frame").alias("idx"), "f0")


POOL = """pool AS (
  SELECT vec_id AS speaker_id, vec_id AS ord,
         CASE WHEN vec_id % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
         label::BIGINT AS cluster, embedding::DOUBLE[] AS xvector
  FROM embeddings)"""
CLUSTERS = """clusters AS (
  SELECT cluster, min(speaker_id) AS centre_speaker, count(*) AS n_speakers,
         row_number() OVER (ORDER BY count(*), cluster) - 1 AS density_pos
  FROM pool GROUP BY cluster)"""
POOL_PITCH = """pool_pitch AS (
  SELECT utt_id AS speaker_id, avg(ln(f0)) AS m, stddev_pop(ln(f0)) AS s, count(*) AS w
  FROM frames WHERE f0 > 0 GROUP BY utt_id)"""

# ---------------------------------------------------------------- segments and words


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \n\t\r]+"), lambda x: x != "")


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, seg, start, end, text, words, first_word."""

    def build():
        turns = table(spark, sf, "conversations").select(
            F.col("conv_id").alias("utt_id"), F.col("turn").alias("seg"), "text",
            split_words(F.col("text")).alias("words"))
        counted = running_sum(turns, "utt_id", F.size("words").cast("bigint"), "first_word",
                              pos="seg", inclusive=False)
        return counted.select(
            "utt_id", "seg", (F.col("first_word") / 2.5).alias("start"),
            ((F.col("first_word") + F.size("words")) / 2.5).alias("end"), "text", "words", "first_word")

    return _once(spark, sf, "segments", build)


def words(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, word_idx, word, start, end."""
    return segments(spark, sf).select(
        "utt_id", "first_word", F.posexplode("words").alias("i", "word")).select(
        "utt_id", (F.col("first_word") + F.col("i")).alias("word_idx"), "word",
        ((F.col("first_word") + F.col("i")) / 2.5).alias("start"),
        ((F.col("first_word") + F.col("i") + 1) / 2.5).alias("end"))


SEGMENTS = r"""segments AS (
  SELECT utt_id, seg, text, words, first_word,
         first_word / 2.5::DOUBLE AS start, (first_word + len(words)) / 2.5::DOUBLE AS "end"
  FROM (SELECT *, coalesce(sum(len(words)) OVER (PARTITION BY utt_id ORDER BY seg
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_word
        FROM (SELECT conv_id AS utt_id, turn AS seg, text,
                     list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> '') AS words
              FROM conversations)))"""
WORDS = """words AS (
  SELECT utt_id, first_word + i - 1 AS word_idx, words[i] AS word,
         (first_word + i - 1) / 2.5::DOUBLE AS start, (first_word + i) / 2.5::DOUBLE AS "end"
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM segments))"""

# ---------------------------------------------------------------- durations, manifest, timings


def durations(spark: SparkSession, sf: str) -> DataFrame:
    """utt_id, pos, symbol_id, dur: symbols with a predicted duration."""

    def build():
        items = table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("utt_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
        return number_rows(items, order, ["utt_id"], out="pos").select(
            "utt_id", "pos", (F.col("l_partkey") % 3).alias("symbol_id"),
            (F.col("l_quantity").cast("bigint") % 5).alias("dur"))

    return _once(spark, sf, "durations", build)


DURATIONS = """durations AS (
  SELECT l_orderkey AS utt_id,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS pos,
         l_partkey % 3 AS symbol_id, l_quantity::BIGINT % 5 AS dur
  FROM lineitem)"""


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, path, sentence, speaker, lang, seconds."""
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".wav")).alias("path"),
        F.col("text").alias("sentence"), F.col("source").alias("speaker"), "lang",
        (F.col("n_chars") / 15.0).alias("seconds"))


MANIFEST = """manifest AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id || '.wav' AS path, text AS sentence,
         source AS speaker, lang, n_chars / 15.0::DOUBLE AS seconds
  FROM documents)"""


def wer_pairs_input(spark: SparkSession, sf: str) -> DataFrame:
    """item_id, ref, hyp: every fifth word dropped, every seventh replaced."""
    toks = split_words(F.col("text"))
    kept = F.filter(
        F.transform(toks, lambda x, i: F.when((i + 1) % 5 == 0, F.lit(None)).when(
            (i + 1) % 7 == 0, F.lit("x")).otherwise(x)),
        lambda x: x.isNotNull())
    return table(spark, sf, "benchmark").select(
        "item_id", F.col("text").alias("ref"), F.array_join(kept, " ").alias("hyp"))


PAIRS = r"""pairs AS (
  SELECT item_id, text AS ref,
         array_to_string(list_filter(list_transform(
           list_filter(regexp_split_to_array(text, '[ \n\t\r]+'), lambda x: x <> ''),
           lambda x, i: CASE WHEN i % 5 = 0 THEN NULL WHEN i % 7 = 0 THEN 'x' ELSE x END),
           lambda x: x IS NOT NULL), ' ') AS hyp
  FROM benchmark)"""


def timings(spark: SparkSession, sf: str) -> DataFrame:
    """grp, stage, seconds, audio_seconds, file, cold, row_id."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_type").isin("view", "click"), "shared analysis")
        .otherwise("end to end").alias("grp"),
        F.col("event_type").alias("stage"), (F.col("value") / 10.0).alias("seconds"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None)).otherwise(
            (4 + F.col("user_id") % 5).cast("double")).alias("audio_seconds"),
        F.col("user_id").alias("file"), (F.col("user_id") == 0).alias("cold"),
        F.col("event_id").alias("row_id"))


TIMINGS = """timings AS (
  SELECT CASE WHEN event_type IN ('view', 'click') THEN 'shared analysis' ELSE 'end to end' END AS grp,
         event_type AS stage, value / 10.0::DOUBLE AS seconds,
         CASE WHEN event_id % 97 = 0 THEN NULL ELSE (4 + user_id % 5)::DOUBLE END AS audio_seconds,
         user_id AS file, user_id = 0 AS cold, event_id AS row_id
  FROM events)"""
