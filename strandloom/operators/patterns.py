"""Interrupter patterns by molecule, and their shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.tract import format_pattern, interrupter_pattern, run_lengths, significant, tuple_text

MIN_PATTERN_FREQ = 0.1


def majority_patterns(rows: DataFrame) -> DataFrame:
    """Pattern with most reads of each molecule, over both strands; ties go to the smallest array."""
    by_pattern = rows.groupBy("locus_id", "mi", interrupter_pattern(F.col("seq")).alias("pattern")).agg(F.sum("cnt").alias("w"))
    first = F.min(F.struct((-F.col("w")).alias("w"), "pattern"))
    return by_pattern.groupBy("locus_id", "mi").agg(first["pattern"].alias("pattern"))


def pattern_shares(majority: DataFrame) -> DataFrame:
    """Share of a locus's molecules that have each pattern."""
    counts = majority.groupBy("locus_id", "pattern").agg(F.count("*").alias("n"))
    totals = counts.groupBy("locus_id").agg(F.sum("n").alias("total"))
    return counts.join(totals, "locus_id").select("locus_id", "pattern", "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


def above(shares: DataFrame, min_freq: float = MIN_PATTERN_FREQ) -> DataFrame:
    return shares.where(F.col("share") >= min_freq)


def admitted(shares: DataFrame, min_freq: float = MIN_PATTERN_FREQ) -> DataFrame:
    """pattern:share of the patterns above the floor, joined: most frequent first, then by pattern."""
    kept = above(shares, min_freq).select(
        "locus_id", F.struct((-F.col("share")).alias("s"), "pattern", F.concat_ws(":", format_pattern(F.col("pattern")), significant(F.col("share"))).alias("text")).alias("e")
    )
    listed = F.array_sort(F.collect_list("e"))
    return kept.groupBy("locus_id").agg(
        F.array_join(F.transform(listed, lambda e: e["text"]), ";").alias("admitted_patterns"), F.count("*").alias("n_admitted_patterns")
    )


def breakdown(rows: DataFrame) -> DataFrame:
    """Rows with their molecule's pattern and their own run lengths."""
    n_runs = rows.select("locus_id", F.size(run_lengths(F.col("seq"))).alias("n")).groupBy("locus_id").agg(F.max("n").alias("n_runs"))
    out = rows.join(majority_patterns(rows), ["locus_id", "mi"]).join(n_runs, "locus_id")
    return out.withColumn("pattern", format_pattern(F.col("pattern"))).withColumn("tuple_str", tuple_text(F.col("seq"), F.col("n_runs")))


def concordance(calls: DataFrame) -> DataFrame:
    """Share of the modal pattern among a label's rows; null without rows."""
    counts = calls.where("phase_label <> 'unk'").groupBy("locus_id", "phase_label", "interrupter_pattern").agg(F.count("*").alias("n"))
    shares = counts.groupBy("locus_id", "phase_label").agg((F.max("n").cast("double") / F.sum("n")).alias("s"))
    one = lambda label: F.max(F.when(F.col("phase_label") == label, F.col("s")))
    return shares.groupBy("locus_id").agg(
        one("hap_major").alias("phase_interrupter_concordance_major"), one("hap_minor").alias("phase_interrupter_concordance_minor")
    )
