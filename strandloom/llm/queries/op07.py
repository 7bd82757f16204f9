"""Shard of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import table
from strandloom.llm.sharding import place

SHARDS = [f"shard-{i:04d}" for i in range(256)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return place(docs, "doc_id", SHARDS).select("doc_id", "source", "n_chars", "slot", "shard")
