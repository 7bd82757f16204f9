"""Commands: python -m strandloom {build-flanks,extract,phase,ref-phase}."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import geometry, patterns, phasing, pipeline, placement, tables
from strandloom.sources import alignments, flanks
from strandloom.sources import tables as text
from strandloom.sources.panel import Panel, panel_info, run_meta
from strandloom.sources.shared import settled


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="strandloom")
    commands = parser.add_subparsers(dest="command", required=True)

    build = commands.add_parser("build-flanks", help="choose the flanking strings of each locus from a normal sample")
    build.add_argument("--bam", required=True)
    build.add_argument("--bed", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("--sample", help="checked against the read groups, needed without any")

    extract = commands.add_parser("extract", help="cut tracts and flanking strings into a panel")
    for name in ("--bam", "--bed", "--flanks", "--out"):
        extract.add_argument(name, required=True)
    extract.add_argument("--min-mapq", type=int, default=40)
    extract.add_argument("--drop-chimeric", action=argparse.BooleanOptionalAction, default=True)
    extract.add_argument("--max-tlen", type=int, default=1000)
    extract.add_argument("--min-flanking-base-q", type=int, default=pipeline.MIN_FLANKING_BASE_Q)
    extract.add_argument("--n-alleles-margin", type=int, default=1)

    phase = commands.add_parser("phase", help="call and phase variants, label rows")
    phase.add_argument("--min-coverage", type=int, default=phasing.MIN_COVERAGE)
    phase.add_argument("--vaf-min", type=float, default=phasing.VAF_MIN)
    phase.add_argument("--min-linkage-families", type=int, default=phasing.MIN_LINKAGE_FAMILIES)
    against = commands.add_parser("ref-phase", help="label rows by the profiles of another panel's variants")
    known = against.add_mutually_exclusive_group(required=True)
    known.add_argument("--reference-snv-calls")
    known.add_argument("--reference-phasing", help="a phasing saved by phase --save")
    against.add_argument("--target-sample-id", default="")
    against.add_argument("--reference-sample-id", default="")
    for command in (phase, against):
        command.add_argument("--panel", required=True)
        command.add_argument("--out", required=True)
        command.add_argument("--save", help="also save variants and labelled rows here")
        command.add_argument("--min-informative-positions", type=int, default=phasing.MIN_INFORMATIVE)
        command.add_argument("--vote-margin", type=int, default=phasing.VOTE_MARGIN)
        command.add_argument("--min-pattern-freq", type=float, default=patterns.MIN_PATTERN_FREQ)
    return parser.parse_args(argv)


def _reads(spark: SparkSession, path: str, loci: DataFrame, reach: int) -> DataFrame:
    if path.endswith(".sam"):
        return alignments.read_sam(spark, path)
    # one interval for each line of the BED file
    found = loci.select("chrom", (F.col("bed_start") - reach).alias("lo"), (F.col("bed_end") + reach).alias("hi")).collect()
    return alignments.read_bam(spark, path, [(r["chrom"], r["lo"], r["hi"]) for r in found])


def _loci(spark: SparkSession, bed: str, table: str) -> DataFrame:
    """BED loci with their flanks and status; both must name the same loci."""
    loci, sides = flanks.read_bed(spark, bed), flanks.read_flank_sides(spark, table)
    differing = flanks.key_differences(loci.select("locus_id"), sides.select(F.col("locus").alias("locus_id")).distinct()).limit(10).collect()
    if differing:
        raise ValueError(f"BED and flank table differ: {[tuple(r) for r in differing]}")
    positions = F.split("flank_ref_positions", ",").cast("array<long>")

    def one(side: str, p: str, run_side_offset: int) -> DataFrame:
        of = sides.where(F.col("side") == side)
        record = flanks.flank_json(F.col("flank_bases"), positions, F.lit(run_side_offset))
        return of.select(F.col("locus").alias("locus_id"), F.col("flank_bases").alias(f"{p}_flank"), F.element_at(positions, -1).alias(f"{p}_run_side"), record.alias(f"{side}_flank"))

    known = sides.where("side = 'upstream'").select(F.col("locus").alias("locus_id"), "ref_orientation", "reference_window_status")
    return loci.join(known, "locus_id").join(one("upstream", "up", placement.FLANK - 1), "locus_id").join(one("downstream", "dn", 0), "locus_id")


def _extract(spark: SparkSession, args: argparse.Namespace) -> None:
    loci = _loci(spark, args.bed, args.flanks)
    reads = _reads(spark, args.bam, loci, args.max_tlen)
    found, counters = pipeline.extract(
        reads, loci.drop("upstream_flank", "downstream_flank"), args.min_mapq, args.drop_chimeric, args.max_tlen, args.min_flanking_base_q
    )
    rows = settled(found.rows)
    meta = settled(run_meta(rows))
    flank_records = loci.select("locus_id", "upstream_flank", "downstream_flank")
    described = found.loci.join(flank_records, "locus_id").join(meta.drop("n_reads"), "locus_id", "left").join(counters, "locus_id").fillna(0, ["n_runs", "max_run"])
    settings = {k: str(v) for k, v in vars(args).items() if k != "command"}
    more = {"info": panel_info(meta, args.n_alleles_margin), "provenance": text.provenance(spark, args.flanks, settings)}
    Panel(rows, described).save(args.out, **more)


def _write(panel: Panel, phased: tables.Phased, args: argparse.Namespace) -> None:
    text.write_tsv(tables.haplotype_calls(phased), f"{args.out}/haplotype_calls", ["locus_id", "mi", "strand", "interrupter_pattern", "count"])
    text.write_snv_calls(tables.snv_calls(phased), f"{args.out}/snv_calls")
    text.write_tsv(tables.locus_summary(panel, phased, args.min_pattern_freq), f"{args.out}/locus_summary", ["locus_id"], one_file=True)
    if args.save:
        phased.save(args.save)
    totals = {r["phase_label"]: r["n"] for r in phased.rows.groupBy("phase_label").agg(F.count("*").alias("n")).collect()}
    usable = phased.snvs.where("status = 'phased'").agg(F.countDistinct("locus_id").alias("loci"), F.count("*").alias("snvs")).first()
    print(json.dumps({**totals, "loci_with_phased_snvs": usable["loci"], "phased_snvs": usable["snvs"]}, sort_keys=True))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    if args.command == "build-flanks":
        beds = flanks.read_bed(spark, args.bed)
        sample = alignments.read_group_sample(args.sample, alignments.read_groups(spark, args.bam))
        text.write_tsv(pipeline.build_flanks(_reads(spark, args.bam, beds, geometry.PAD), beds, sample), args.out, ["locus", F.desc("side")], one_file=True)
    elif args.command == "extract":
        _extract(spark, args)
    elif args.command == "phase":
        panel = Panel.load(spark, args.panel)
        _write(panel, tables.phase(panel, args.min_coverage, args.vaf_min, args.min_linkage_families, args.min_informative_positions, args.vote_margin), args)
    else:
        target = Panel.load(spark, args.panel)
        if args.reference_phasing:
            snvs = tables.Phased.load(spark, args.reference_phasing).snvs
        else:
            snvs = text.read_snv_calls(spark, args.reference_snv_calls).withColumn("offset", F.lit(0))
        phased = tables.phase_by_reference(target, snvs, args.min_informative_positions, args.vote_margin)
        _write(target, phased, args)
        text.write_tsv(tables.ref_phasing_summary(target, phased), f"{args.out}/ref_phasing_summary", ["locus_id"], one_file=True)
        print(json.dumps({"target": args.target_sample_id, "reference": args.reference_sample_id}))


if __name__ == "__main__":
    main()
