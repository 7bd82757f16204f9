"""The result tables of phasing and of phasing against a reference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.tract import format_pattern, offset_at_ref_pos
from strandloom.operators import patterns, phasing
from strandloom.sources.panel import Panel, load_versioned, save_versioned
from strandloom.sources.shared import settled

SNV_COLUMNS = [
    "locus_id", "ref_pos", "segment", "string_index", "allele_major", "allele_minor", "vaf_minor", "coverage", "status",
    "hap_major_base", "hap_minor_base", "is_anchor", "pair_discordance", "pair_double_coverage",
]


PHASING_VERSION = "1"


@dataclass
class Phased:
    """Variants with their phase, and panel rows with votes and labels."""

    snvs: DataFrame
    rows: DataFrame

    def save(self, path: str) -> None:
        save_versioned(self.rows.sparkSession, path, {"snvs": self.snvs, "rows": self.rows}, PHASING_VERSION)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Phased:
        read = load_versioned(spark, path, PHASING_VERSION)
        return Phased(read("snvs"), read("rows"))


def phase(panel: Panel, min_coverage=phasing.MIN_COVERAGE, vaf_min=phasing.VAF_MIN, min_linkage_families=phasing.MIN_LINKAGE_FAMILIES,
          min_informative_positions=phasing.MIN_INFORMATIVE, vote_margin=phasing.VOTE_MARGIN) -> Phased:
    # variants are few and patterns fewer than molecules; all tables that follow read the labelled rows
    called = settled(phasing.call_patterns(panel.rows))
    found = settled(phasing.informative_snvs(panel, min_coverage, vaf_min, called))
    snvs = settled(phasing.haplotypes(panel, found, min_linkage_families, called))
    return Phased(snvs, settled(phasing.assign(panel, snvs, min_informative_positions, vote_margin)))


def haplotype_calls(phased: Phased, majority: DataFrame | None = None) -> DataFrame:
    """One row for each panel row: its molecule's pattern, its label and votes."""
    pattern = (majority or patterns.majority_patterns(phased.rows)).withColumn("interrupter_pattern", format_pattern(F.col("pattern"))).drop("pattern")
    return phased.rows.join(pattern, ["locus_id", "mi"]).select(
        "locus_id", "mi", "strand", F.col("cnt").alias("count"), "interrupter_pattern", "phase_label", "n_major", "n_minor", "n_other"
    )


def snv_calls(phased: Phased) -> DataFrame:
    return phased.snvs.select(*SNV_COLUMNS)


def _reads_by_label(rows: DataFrame) -> list:
    of = lambda label: F.sum(F.when(F.col("phase_label") == label, F.col("cnt")).otherwise(0))
    return [F.sum("cnt").alias("reads_total"), of("hap_major").alias("reads_major"), of("hap_minor").alias("reads_minor"), of("unk").alias("reads_unk")]


def locus_summary(panel: Panel, phased: Phased, min_pattern_freq: float = patterns.MIN_PATTERN_FREQ) -> DataFrame:
    rows = phased.rows
    totals = rows.groupBy("locus_id").agg(F.count("*").alias("n_rows"), *_reads_by_label(rows))
    majority = settled(patterns.majority_patterns(rows))
    families = majority.groupBy("locus_id").agg(F.count("*").alias("n_rfs"))
    snvs = phased.snvs
    is_phased = F.col("status") == "phased"
    listed = F.array_sort(F.collect_list(F.when(is_phased, F.struct("offset", "hap_major_base", "hap_minor_base"))))
    by_locus = snvs.groupBy("locus_id").agg(
        F.array_join(F.transform(listed, lambda s: s["hap_major_base"]), "").alias("hap_major_profile"),
        F.array_join(F.transform(listed, lambda s: s["hap_minor_base"]), "").alias("hap_minor_profile"),
        F.count_if(is_phased).alias("n_snvs_phased"), F.count_if(~is_phased).alias("n_snvs_dropped_low_linkage"),
        F.coalesce(F.max(F.when(is_phased & ~F.col("is_anchor"), F.col("pair_discordance"))), F.lit(0.0)).alias("max_discordance"),
        F.max(F.when(F.col("is_anchor"), F.col("coverage"))).alias("n_anchor_families"),
    )
    calls = haplotype_calls(phased, majority)
    out = (
        panel.loci.select("locus_id").join(totals, "locus_id", "left").join(families, "locus_id", "left")
        .join(patterns.admitted(patterns.pattern_shares(majority), min_pattern_freq), "locus_id", "left")
        .join(by_locus, "locus_id", "left").join(patterns.concordance(calls), "locus_id", "left")
    )
    numbers = ["n_rfs", "n_rows", "n_admitted_patterns", "n_snvs_phased", "n_snvs_dropped_low_linkage", "n_anchor_families", "reads_total", "reads_major", "reads_minor", "reads_unk"]
    out = out.fillna(0, numbers).fillna("", ["admitted_patterns", "hap_major_profile", "hap_minor_profile"]).fillna(0.0, ["max_discordance"])
    return out.select(
        "locus_id", "n_rfs", "n_rows", "admitted_patterns", "n_admitted_patterns", "hap_major_profile", "hap_minor_profile", "n_snvs_phased",
        "n_snvs_dropped_low_linkage", "max_discordance", "n_anchor_families", "reads_total", "reads_major", "reads_minor", "reads_unk",
        "phase_interrupter_concordance_major", "phase_interrupter_concordance_minor",
    )


def remap(snvs: DataFrame, loci: DataFrame) -> DataFrame:
    """Phased variants of a reference with their offset in a target panel; those outside its window go."""
    phased = snvs.where("status = 'phased'").drop("offset").join(loci, "locus_id")
    orientation, pos = F.col("ref_orientation"), F.col("ref_pos")
    up = offset_at_ref_pos(orientation, F.col("up_start"), pos, F.col("up_width"))
    down = offset_at_ref_pos(orientation, F.col("dn_start"), pos, F.col("dn_width"))
    at = F.coalesce(up, F.col("up_width") + 1 + down).cast("int")
    kept = phased.withColumn("target_offset", at).where("target_offset is not null")
    return kept.drop(*[c for c in loci.columns if c != "locus_id"])


def phase_by_reference(target: Panel, reference_snvs: DataFrame, min_informative_positions=phasing.MIN_INFORMATIVE, vote_margin=phasing.VOTE_MARGIN) -> Phased:
    """Label a target panel's rows by the profiles of a reference panel.

    The variants keep the reference's alleles, profiles and anchor; position,
    coverage and allele share are the target's, linkage columns are null.
    """
    usable = remap(reference_snvs, target.loci)
    profile = usable.withColumn("offset", F.col("target_offset"))
    rows = settled(phasing.labelled(phasing.row_votes(target.rows, phasing.profiles(profile)), min_informative_positions, vote_margin))
    counts = phasing.family_counts(phasing.call_patterns(target.rows), profile)
    joined = profile.drop("coverage", "vaf_minor", "segment", "string_index").join(counts, ["locus_id", "offset"], "left").fillna(0, [f"fam_{b}" for b in phasing.BASES])
    joined = joined.join(target.loci.select("locus_id", "up_width"), "locus_id")
    coverage = sum((F.col(f"fam_{b}") for b in phasing.BASES[1:]), F.col("fam_A"))
    minor = F.coalesce(*[F.when(F.col("allele_minor") == b, F.col(f"fam_{b}")) for b in phasing.BASES], F.lit(0))
    up = F.col("offset") < F.col("up_width")
    snvs = joined.select(
        "locus_id", "offset", "ref_pos", F.when(up, "up").otherwise("dn").alias("segment"),
        F.when(up, F.col("offset")).otherwise(F.col("offset") - F.col("up_width") - 1).cast("long").alias("string_index"), "allele_major", "allele_minor",
        F.when(coverage > 0, minor.cast("double") / coverage).alias("vaf_minor"), coverage.alias("coverage"), "status", "hap_major_base", "hap_minor_base",
        "is_anchor", F.lit(None).cast("double").alias("pair_discordance"), F.lit(None).cast("long").alias("pair_double_coverage"),
    )
    return Phased(snvs, rows)


def ref_phasing_summary(target: Panel, phased: Phased) -> DataFrame:
    totals = phased.rows.groupBy("locus_id").agg(F.count("*").alias("n_rows"), *_reads_by_label(phased.rows))
    molecules = phased.rows.groupBy("locus_id", "mi").agg(F.max(F.col("phase_label") != "unk").alias("some"))
    families = molecules.groupBy("locus_id").agg(F.count("*").alias("n_families"), F.count_if("some").alias("n_families_labeled"))
    usable = phased.snvs.groupBy("locus_id").agg(F.count("*").alias("n_usable_snvs"))
    out = target.loci.select("locus_id").join(usable, "locus_id", "left").join(totals, "locus_id", "left").join(families, "locus_id", "left").fillna(0)
    return out.select("locus_id", "n_usable_snvs", "n_rows", "n_families", "n_families_labeled", "reads_total", "reads_major", "reads_minor", "reads_unk")
