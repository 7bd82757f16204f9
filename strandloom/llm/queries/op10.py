"""Language of every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.llm.langid import identify_documents, identify_pages


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_documents(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("row.lang").alias("declared"), "lang", "confidence", "rejected")


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with markup, address suffix, host and domain as evidence."""
    found = identify_pages(table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select(F.col("row.page_id").alias("page_id"), "lang", "confidence", "rejected")
