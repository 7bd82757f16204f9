"""Personal data in every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import pii
from strandloom.llm.common import durable, table


def spans_of(docs: DataFrame) -> DataFrame:
    """Counts, hash and list of the spans of docs (doc_id, text)."""
    found, _ = durable(docs.select("doc_id", pii.candidates("text").alias("spans")), "pii-candidates")
    model = pii.fit(found)
    kept = found.select("doc_id", pii.accepted("spans", model).alias("spans"))
    kept = kept.withColumn("base", F.expr("filter(spans, c -> c.base)"))
    counts = [F.expr(f"cast(size(filter(base, c -> c.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE]
    return kept.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
