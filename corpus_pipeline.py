"""A corpus pipeline over the documents table: five stages, each one operator.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it again as the next stage's docs. All but the last return documents' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import mixing, pii
from strandloom.llm.common import discard, durable, scratch, step, table
from strandloom.llm.langid import identify_documents
from strandloom.llm.queries.op06 import digests
from strandloom.llm.simhash import representatives

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@step
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; lang becomes the identified one, rejected documents go.

    Null, empty and letterless texts are rejected. Null declarations and sources
    are silent evidence. Repeated rows fare alike; extra columns are not read.
    """
    found = identify_documents(docs.select(*COLUMNS)).where(~F.col("rejected"))
    return found.select("row.doc_id", "row.text", "lang", "row.source", "row.n_chars")


@step
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A group without any id keeps one of its rows. Rows are told apart by more
    than their id: texts that share one stay if they are no copies. Null and
    blank texts are copies of each other. Extra columns are not read.
    """
    return representatives(docs.select(*COLUMNS))


@step
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each found span replaced by the name of its kind.

    Null and empty texts stay as they are. n_chars becomes the new length where
    something was replaced. Extra columns are not read.
    """
    found, _ = durable(docs.select(*COLUMNS, pii.candidates("text").alias("spans")), "pipeline-spans", "zstd")
    found = found.withColumn("spans", pii.accepted("spans", pii.fit(found.select("spans"))))
    marked = F.size("spans") > 0
    return found.select(
        "doc_id",
        pii.redacted("text", "spans").alias("text"),
        "lang",
        "source",
        F.when(marked, F.length(pii.redacted("text", "spans")).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


@step
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is drawn.

    Texts without words are drawn with their block. Null sources are one source.
    Repeated rows are drawn on their own. Extra columns are not read.
    """
    return mixing.mix(docs.select(*COLUMNS))


@step
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of the encoded and decoded documents; null texts count as empty ones."""
    return digests(docs)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: SQL has neither the trained models nor the hashes of the stages; tests hold
#: each stage against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What a stage wrote goes as soon as the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs, path = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.add(path)
        if before:
            discard(spark, before)
        before = path
    return docs
