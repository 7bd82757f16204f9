"""Words that the mix takes of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.llm.mixing import placements


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = placements(docs, keep=["doc_id"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("draws")).alias("taken"),
        F.transform("draws", lambda d: d["shard"]).alias("shards"),
    )
