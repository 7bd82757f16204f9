"""Per-locus summaries for browsing: tracts, run lengths, pile-ups, locus lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions.tract import base_at, run_lengths
from strandloom.operators.tables import Phased
from strandloom.sources.panel import Panel

TRACT_ROWS = 200
PILEUP_ROWS = 150
NEAR, MOST_NEAR = 3, 50


def _top(rows: DataFrame, keys: list[str], by: list[str], n: int) -> DataFrame:
    """The n rows of each group with most reads, and the reads of the others as one total."""
    order = W.partitionBy(*keys).orderBy(F.desc("reads"), *by)
    ranked = rows.withColumn("rank", F.row_number().over(order))
    total = W.partitionBy(*keys)
    rest = F.sum(F.when(F.col("rank") > n, F.col("reads")).otherwise(0)).over(total)
    return ranked.withColumn("reads_not_shown", rest).where(F.col("rank") <= n)


def tracts(rows: DataFrame, n: int = TRACT_ROWS) -> DataFrame:
    """Most read tracts of each locus with their reads and molecules.

    A first aggregation by molecule leaves plain counts for the second, so no
    set of molecules is ever held.
    """
    by_molecule = rows.groupBy("locus_id", "seq", "mi").agg(F.sum("cnt").alias("cnt"))
    summed = by_molecule.groupBy("locus_id", "seq").agg(F.sum("cnt").alias("reads"), F.count("*").alias("molecules"))
    return _top(summed, ["locus_id"], ["seq"], n)


def largest_runs(rows: DataFrame) -> DataFrame:
    """Reads by the length of the largest G run, for each locus and label."""
    tracts_read = rows.groupBy("locus_id", "phase_label", "seq").agg(F.sum("cnt").alias("cnt"))
    run = F.array_max(run_lengths(F.col("seq")))
    return tracts_read.groupBy("locus_id", "phase_label", run.alias("largest_run")).agg(F.sum("cnt").alias("reads"))


def largest_run_shares(rows: DataFrame) -> DataFrame:
    runs = largest_runs(rows)
    totals = runs.groupBy("locus_id", "phase_label").agg(F.sum("reads").alias("total"))
    return runs.join(totals, ["locus_id", "phase_label"]).select(
        "locus_id", "phase_label", "largest_run", (F.col("reads").cast("double") / F.col("total")).alias("share")
    )


def shown_offsets(panel: Panel, snvs: DataFrame, near: int = NEAR) -> DataFrame:
    """Offsets of the pile-up columns: the nearest on each side, 0 to MOST_NEAR, and those of the variants."""
    near = min(max(near, 0), MOST_NEAR)
    steps = F.array(*map(F.lit, range(1, near + 1))).cast("array<int>")
    close = panel.loci.select(
        "locus_id",
        F.explode(
            F.concat(
                F.filter(F.transform(steps, lambda i: F.col("up_width") - i), lambda i: i >= 0),
                F.filter(F.transform(steps, lambda i: F.col("up_width") + i), lambda i: i <= F.col("up_width") + F.col("dn_width")),
            )
        ).alias("offset"),
    ).withColumn("offset", F.col("offset").cast("int"))
    return close.union(snvs.select("locus_id", F.col("offset").cast("int"))).distinct()


def pileup(panel: Panel, phased: Phased, near: int = NEAR, n: int = PILEUP_ROWS) -> DataFrame:
    """Reads alike in tract, label and shown bases, the most read first in each label's section.

    differs lists the offsets of phased variants whose base is neither '.' nor
    the label's.
    """
    columns = shown_offsets(panel, phased.snvs, near).groupBy("locus_id").agg(F.array_sort(F.collect_list("offset")).alias("columns"))
    entry = F.struct(F.col("offset").cast("int").alias("offset"), "hap_major_base", "hap_minor_base")
    bases = phased.snvs.where("status = 'phased'").groupBy("locus_id").agg(F.array_sort(F.collect_list(entry)).alias("phased"))
    text = F.array_join(F.transform("columns", lambda i: base_at(F.col("flanking_seq"), i)), "")
    keyed = phased.rows.join(columns, "locus_id").withColumn("shown", text)
    by_molecule = keyed.groupBy("locus_id", "phase_label", "seq", "shown", "mi").agg(F.sum("cnt").alias("cnt"), F.first("columns").alias("columns"))
    summed = by_molecule.groupBy("locus_id", "phase_label", "seq", "shown").agg(
        F.sum("cnt").alias("reads"), F.count("*").alias("molecules"), F.first("columns").alias("columns")
    )
    top = _top(summed, ["locus_id", "phase_label"], ["seq", "shown"], n).join(bases, "locus_id", "left")
    base = lambda s: base_at(F.col("shown"), F.array_position("columns", s["offset"]).cast("int") - 1)
    own = lambda s: F.when(F.col("phase_label") == "hap_major", s["hap_major_base"]).when(F.col("phase_label") == "hap_minor", s["hap_minor_base"])
    marks = F.filter("phased", lambda s: (base(s) != ".") & (base(s) != own(s)))
    differs = F.array_join(F.transform(marks, lambda s: s["offset"].cast("string")), ",")
    return top.select("locus_id", "phase_label", "seq", "shown", "reads", "molecules", "rank", "reads_not_shown", F.coalesce(differs, F.lit("")).alias("differs"))


def sections(rows: DataFrame) -> DataFrame:
    """Reads and molecules of each locus and label; a molecule counts under each of its labels."""
    by_molecule = rows.groupBy("locus_id", "phase_label", "mi").agg(F.sum("cnt").alias("cnt"))
    return by_molecule.groupBy("locus_id", "phase_label").agg(F.sum("cnt").alias("reads"), F.count("*").alias("molecules"))


def panel_overview(panel: Panel, snvs: DataFrame) -> DataFrame:
    """Reads, molecules, largest run and variants of each locus.

    A panel whose loci have a status lists all of them, with it and whether a
    side has no reference position.
    """
    by_molecule = panel.rows.groupBy("locus_id", "mi").agg(F.sum("cnt").alias("cnt"), F.max(F.array_max(run_lengths(F.col("seq")))).alias("run"))
    reads = by_molecule.groupBy("locus_id").agg(F.sum("cnt").alias("n_reads"), F.count("*").alias("molecules"), F.max("run").alias("largest_run"))
    status = snvs.groupBy("locus_id").agg(F.count_if(F.col("status") == "phased").alias("phased"), F.count_if(F.col("status") != "phased").alias("dropped"))
    if "reference_window_status" in panel.loci.columns:
        known = panel.loci.select(
            "locus_id", F.col("reference_window_status").alias("status"), ((F.col("up_start") < 0) | (F.col("dn_start") < 0)).alias("no_position")
        )
        reads = known.join(reads, "locus_id", "left").fillna(0, ["n_reads", "molecules"])
    return reads.join(status, "locus_id", "left").fillna(0, ["phased", "dropped"])


def locus_list(*overviews: DataFrame) -> DataFrame:
    """Loci of any number of overviews, whose columns are numbered from 1; a panel without the locus has nulls."""
    out = None
    for i, df in enumerate(overviews, 1):
        renamed = df.select("locus_id", *[F.col(c).alias(f"{c}_{i}") for c in df.columns if c != "locus_id"])
        out = renamed if out is None else out.join(renamed, "locus_id", "full")
    return out


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables holds, with how often."""
    columns = a.columns
    only = a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
    return only.groupBy(*columns, "side").agg(F.count("*").alias("n"))


def order_mismatches(calls: DataFrame, rows: DataFrame) -> DataFrame:
    """Per locus, rows of a saved table whose identity at their position is not the panel's."""
    names = ["mi", "strand", "cnt"]
    left = calls.select("locus_id", "row_ord", F.struct(*names).alias("a"))
    right = rows.select("locus_id", "row_ord", F.struct(*names).alias("b"))
    joined = left.join(right, ["locus_id", "row_ord"], "full")
    return joined.groupBy("locus_id").agg(F.count("*").alias("n_rows"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("n_mismatches"))
