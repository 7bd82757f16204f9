"""BED loci and the flank side table, with their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE_SCHEMA = (
    "sample string, locus string, side string, reference_window_status string, ref_orientation string, flank_bases string, "
    "flank_ref_positions string, objective double, n_reads long, n_reads_placed long, n_tied_pairs long, n_reads_positioned long, n_reads_at_position long"
)
# The statuses of a side.
RECOVERED, NO_WINDOW, NO_PAIR, NO_POSITION = "recovered", "ref_window_unrecoverable", "no_flank_pair", "no_reference_position"


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Loci of a BED file: locus_id, chrom, bed_start, bed_end; blank and '#' lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'").select(F.split("value", "\t").alias("f"))
    return lines.select(F.col("f")[3].alias("locus_id"), F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("bed_start"), F.col("f")[2].cast("long").alias("bed_end"))


def read_flank_sides(spark: SparkSession, path: str) -> DataFrame:
    """The side table of one sample; a table that breaks a rule is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, emptyValue="", nullValue="")
    missing = {"sample", "reference_window_status"} - set(raw.columns)
    if missing:
        raise ValueError(f"flank table {path} lacks {sorted(missing)}")
    sides = spark.read.schema(SIDE_SCHEMA).csv(path, sep="\t", header=True, emptyValue="", nullValue="")
    broken = {k: v for k, v in violations(sides).first().asDict().items() if v}
    if broken:
        raise ValueError(f"flank table {path}: {broken}")
    return sides


def violations(sides: DataFrame) -> DataFrame:
    """One row that counts the breaches of each rule."""
    status = F.col("reference_window_status")
    no_flank = status.isin(NO_WINDOW, NO_PAIR)
    filled = F.coalesce(F.col("flank_bases"), F.col("flank_ref_positions")).isNotNull()
    per_locus = sides.groupBy("locus").agg(
        F.count_if(F.col("side") == "upstream").alias("up"), F.count_if(F.col("side") == "downstream").alias("dn"), F.count("*").alias("n"),
        F.min(F.when(no_flank, status)).alias("low"), F.max(F.when(no_flank, status)).alias("high"), F.count_if(no_flank).alias("gone"),
    )
    by_locus = per_locus.agg(
        F.count_if((F.col("up") != 1) | (F.col("dn") != 1) | (F.col("n") != 2)).alias("not_two_sides"),
        F.count_if((F.col("gone") > 0) & ((F.col("gone") != F.col("n")) | (F.col("low") != F.col("high")))).alias("status_differs"),
    )
    by_row = sides.agg(
        F.greatest(F.count_distinct("sample") - 1, F.lit(0)).alias("more_than_one_sample"),
        F.count_if(~F.coalesce(status.isin(RECOVERED, NO_WINDOW, NO_PAIR, NO_POSITION), F.lit(False))).alias("unknown_status"),
        F.count_if(no_flank & filled).alias("flank_where_none"),
        F.count_if((status == RECOVERED) != F.col("flank_ref_positions").isNotNull()).alias("position_without_recovery"),
    )
    return by_row.crossJoin(F.broadcast(by_locus))


def key_differences(bed: DataFrame, flanks: DataFrame) -> DataFrame:
    """Loci that only one of BED and flank table has."""
    missing = bed.join(flanks, "locus_id", "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(flanks.join(bed, "locus_id", "left_anti").withColumn("side", F.lit("extra")))


def flanks_of_normals(samples: DataFrame, flanks: DataFrame) -> DataFrame:
    """Each sample with the flank table of its normal: samples has sample_id and normal."""
    return samples.join(flanks.withColumnRenamed("sample", "normal"), "normal")


_RECORD = "bases string, ref_positions array<long>, run_side_offset int"


def flank_json(bases: Column, ref_positions: Column, run_side_offset: Column) -> Column:
    """A flank record as JSON text; null without bases."""
    record = F.struct(bases.alias("bases"), F.coalesce(ref_positions, F.array().cast("array<long>")).alias("ref_positions"), run_side_offset.cast("int").alias("run_side_offset"))
    return F.when(bases.isNotNull(), F.to_json(record))


def flank_from_json(text: Column) -> Column:
    """The struct (bases, ref_positions, run_side_offset) of a JSON flank record; the inverse of flank_json()."""
    return F.from_json(text, _RECORD)
