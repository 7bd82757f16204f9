"""Result tables as tab-separated text, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SNV_SCHEMA = (
    "locus_id string, ref_pos long, segment string, string_index long, allele_major string, allele_minor string, vaf_minor double, coverage long, status string, "
    "hap_major_base string, hap_minor_base string, is_anchor boolean, pair_discordance double, pair_double_coverage long"
)


def write_tsv(df: DataFrame, path: str, order: list, one_file: bool = False) -> None:
    """A table with header lines and blanks for nulls, sorted through its files in the order of their names.

    one_file: merge it into one file, for tables with a few rows a locus.
    """
    ordered = df.orderBy(*order)
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def write_snv_calls(snvs: DataFrame, path: str) -> None:
    """Phased variants first, then the dropped ones, by locus and position in the string."""
    rank = [F.when(F.col("status") == "phased", 0).otherwise(1), F.when(F.col("segment") == "up", 0).otherwise(1)]
    write_tsv(snvs, path, ["locus_id", *rank, "string_index"], one_file=True)


def read_snv_calls(spark: SparkSession, path: str) -> DataFrame:
    """Variants of a saved table. A blank linkage column is null, so tables phased by reference can be read too."""
    return spark.read.schema(SNV_SCHEMA).csv(path, sep="\t", header=True, nullValue="", emptyValue="")


def haplotypes_from_calls(snvs: DataFrame) -> DataFrame:
    """One row a locus with phased variants: profiles, largest discordance, molecules of the anchor."""
    phased = snvs.where("status = 'phased'")
    rank = F.row_number().over(W.partitionBy("locus_id").orderBy(F.when(F.col("segment") == "up", 0).otherwise(1), "string_index"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "hap_major_base", "hap_minor_base")))
    return phased.withColumn("ord", rank).groupBy("locus_id").agg(
        F.array_join(F.transform(listed, lambda s: s["hap_major_base"]), "").alias("hap_major_profile"),
        F.array_join(F.transform(listed, lambda s: s["hap_minor_base"]), "").alias("hap_minor_profile"),
        F.coalesce(F.max(F.when(~F.col("is_anchor"), F.col("pair_discordance"))), F.lit(0.0)).alias("max_discordance"),
        F.coalesce(F.max(F.when(F.col("is_anchor"), F.col("coverage"))), F.lit(0).cast("long")).alias("n_anchor_families"),
    )


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A saved haplotype_calls table; an unknown label is an error."""
    schema = "locus_id string, mi string, strand string, count long, interrupter_pattern string, phase_label string, n_major int, n_minor int, n_other int"
    calls = spark.read.schema(schema).csv(path, sep="\t", header=True, nullValue="", emptyValue="")
    if not calls.where("phase_label IS NULL OR phase_label NOT IN ('hap_major', 'hap_minor', 'unk')").isEmpty():
        raise ValueError(f"{path} has unknown phase labels")
    return calls


SUMMARY_SCHEMA = (
    "locus_id string, n_rfs long, n_rows long, admitted_patterns string, n_admitted_patterns long, hap_major_profile string, hap_minor_profile string, "
    "n_snvs_phased long, n_snvs_dropped_low_linkage long, max_discordance double, n_anchor_families long, reads_total long, reads_major long, reads_minor long, "
    "reads_unk long, phase_interrupter_concordance_major double, phase_interrupter_concordance_minor double"
)


def read_locus_summary(spark: SparkSession, path: str) -> DataFrame:
    """A saved locus_summary table. A blank text is an empty one, not a missing one."""
    found = spark.read.schema(SUMMARY_SCHEMA).csv(path, sep="\t", header=True, nullValue="", emptyValue="")
    return found.fillna("", ["admitted_patterns", "hap_major_profile", "hap_minor_profile"])


def read_phasing_folder(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the phase command writes into a folder."""
    return {
        "haplotype_calls": read_labels(spark, f"{path}/haplotype_calls"),
        "snv_calls": read_snv_calls(spark, f"{path}/snv_calls"),
        "locus_summary": read_locus_summary(spark, f"{path}/locus_summary"),
    }


def provenance(spark: SparkSession, flank_table: str, settings: dict[str, str]) -> DataFrame:
    """One row: hash of the flank table's bytes, settings, merge policy and schema version."""
    from strandloom.sources.panel import SCHEMA_VERSION

    files = spark.read.format("binaryFile").load(flank_table).select("path", F.sha2("content", 256).alias("sha"))
    listed = F.array_sort(F.collect_list(F.struct("path", "sha")))
    # of a table in several files, the hash of their hashes in the order of their names
    shas = files.agg(F.transform(listed, lambda f: f["sha"]).alias("shas"))
    digest = shas.select(F.when(F.size("shas") == 1, F.col("shas")[0]).otherwise(F.sha2(F.array_join("shas", "\n"), 256)).alias("flank_table_sha256"))
    fixed = {"policy": "merge_by_quality", "schema_version": SCHEMA_VERSION, **settings}
    return digest.select("flank_table_sha256", *[F.lit(v).alias(k) for k, v in sorted(fixed.items())])
