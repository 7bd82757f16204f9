"""Digest of byte-level BPE over every whole document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.bpe import round_trip
from strandloom.llm.common import bounded_batches, table

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def digests(docs: DataFrame, rank_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded bytes."""
    if rank_path is None or pattern is None:
        import public_tokenizers

        rank_path = rank_path or public_tokenizers.path(RANK_FILE)
        pattern = pattern or public_tokenizers.PATTERN
    coded = bounded_batches(docs).select("doc_id", round_trip(rank_path, pattern, F.col("text")).alias("coded"))
    return coded.select(
        "doc_id",
        (F.octet_length("coded.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
