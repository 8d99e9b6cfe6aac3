"""A corpus pipeline: the stages, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input. A document without text
passes the stages as an empty one; what each operator does with nulls, ties and
repeated rows is stated in its own module.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import decontaminate, line_dedup, near_dedup, packing, quality
from framewright.llm.queries import held_out, table, tokenizer_path
from framewright.session import scratch_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.7 or more)."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out("id", 4, 2))
    scored = quality.score(docs, weights, out="_quality_score")
    return scored.filter(F.col("_quality_score") >= 0.7).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; ``n_chars`` follows the text."""
    kept = line_dedup.drop_repeated_lines(docs, prefix="_")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate class."""
    return near_dedup.keep_first_of_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    judged = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), prefix="_")
    return judged.filter(~F.col("_contaminated")).select(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("near dedup", keep_one_of_class),
    ("decontamination", drop_contaminated),
    ("packing", pack_tokens),
]
#: SQL cannot express the trained classifier, the signatures and the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediates go to the session's shared folder."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
