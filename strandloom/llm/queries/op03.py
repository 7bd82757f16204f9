"""Toxicity score of every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.llm.toxicity import THRESHOLD, learn, score_column


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learned from: a quarter of the ids, by CRC-32."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = docs.select("doc_id", held_out().alias("held_out"), score_column(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
