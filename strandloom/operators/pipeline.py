"""The whole way from alignments and flanks to a panel, and from alignments to flanks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import alignment as al
from strandloom.functions.tract import in_tract_orientation, mask_low_quality, run_lengths
from strandloom.operators import extraction, flank_search, geometry, placement
from strandloom.sources.flanks import NO_PAIR, NO_WINDOW, RECOVERED
from strandloom.sources.panel import Panel
from strandloom.sources.shared import settled as kept_once

MIN_FLANKING_BASE_Q = 20


def tested_reads(alignments: DataFrame, loci: DataFrame, min_mapq=extraction.MIN_MAPQ, drop_chimeric=True, max_tlen=extraction.MAX_TLEN) -> DataFrame:
    """Reads near each locus with their drop reason, turned to tract orientation, with their marks.

    loci: locus_id, chrom, bed_start, bed_end, ref_orientation.
    """
    near = extraction.near_loci(alignments.withColumn("end0", al.reference_end(F.col("cigar"), F.col("pos0"))), loci, max_tlen)
    tested = extraction.filtered(near, min_mapq, drop_chimeric, max_tlen)
    blocks = al.aligned_blocks(F.col("cigar"), F.col("pos0"))
    out = tested.withColumn("blocks", blocks).withColumn("raw", F.col("seq"))
    return out.withColumns({
        "seq": in_tract_orientation(F.col("raw"), F.col("ref_orientation")),
        "marks": al.bed_marks(F.col("blocks"), F.col("bed_start"), F.col("bed_end"), F.col("ref_orientation"), F.length("raw")),
    })


def build_flanks(alignments: DataFrame, loci: DataFrame, sample: str) -> DataFrame:
    """The flank side table of a normal sample.

    loci: locus_id, chrom, bed_start, bed_end. Default filters hold, whatever
    extraction is run with.
    """
    near = extraction.near_loci(alignments.withColumn("end0", al.reference_end(F.col("cigar"), F.col("pos0"))), loci, 0)
    windows = geometry.reference_windows(near)
    walks = kept_once(geometry.reference_walks(windows, loci).select("locus_id", "ref_orientation", "window", "window_start"))
    turned = loci.join(walks.select("locus_id", "ref_orientation"), "locus_id")
    # reads alike in all that is asked for are one row with a weight
    reads = tested_reads(alignments, turned).where("overlaps AND drop_reason IS NULL")
    reads = kept_once(reads.groupBy("locus_id", "ref_orientation", "seq", "marks", "blocks").agg(F.count("*").alias("weight")))
    counted = reads.groupBy("locus_id", "seq", "marks").agg(F.sum("weight").alias("weight"))
    pairs = kept_once(flank_search.best_pairs(counted))
    placed = kept_once(placement.place(reads.join(pairs.select("locus_id", "up_flank", "dn_flank"), "locus_id")).where("kept"))
    wrong = flank_search.mismatches(placed.withColumn("value", F.col("value") * F.col("weight")), pairs).limit(10).collect()
    if wrong:
        raise AssertionError(f"placement and search disagree: {[r.asDict() for r in wrong]}")
    at = lambda i: al.reference_coordinate(F.col("blocks"), F.col(i), F.col("ref_orientation"), F.length("seq"))
    plus = F.when(F.col("ref_orientation") == "-", -1).otherwise(1)
    sides = [
        placed.select("locus_id", "weight", F.lit(s).alias("side"), at(outer).alias("outer_pos"), at(run).alias("run_pos"), (plus * sign).alias("toward_run"))
        for s, outer, run, sign in (("up", "up_outer", "a", 1), ("dn", "dn_outer", "b", -1))
    ]
    both = sides[0].unionByName(sides[1]).where("outer_pos >= 0 AND run_pos >= 0")
    modal = flank_search.modal_positions(both)
    positions = geometry.voted_positions(placed, turned, modal)
    n_placed = placed.groupBy("locus_id").agg(F.sum("weight").alias("n_reads_placed"))
    n_reads = reads.groupBy("locus_id").agg(F.sum("weight").alias("n_reads"))
    found = pairs.join(n_placed, "locus_id", "left").join(positions.drop("chrom", "bed_start", "bed_end", "ref_orientation"), "locus_id", "left")
    known = loci.select("locus_id").join(walks, "locus_id", "left").join(n_reads, "locus_id", "left")
    known = known.select("locus_id", F.col("window").isNotNull().alias("has_window"), "ref_orientation", F.coalesce("n_reads", F.lit(0)).cast("long").alias("n_reads"))
    return geometry.side_table(known, found, sample)


def _with_windows(alignments: DataFrame, loci: DataFrame, min_mapq: int) -> DataFrame:
    """Loci that have flanks and a reference window in this sample, with the window and its G walks."""
    usable = loci.where("up_flank IS NOT NULL AND dn_flank IS NOT NULL")
    near = extraction.near_loci(alignments.withColumn("end0", al.reference_end(F.col("cigar"), F.col("pos0"))), usable, 0)
    walks = geometry.reference_walks(geometry.reference_windows(near, min_mapq), usable.drop("ref_orientation"))
    return usable.join(walks.select("locus_id", "window", "window_start", "walk_up", "walk_dn"), "locus_id")


def extract(alignments: DataFrame, loci: DataFrame, min_mapq=extraction.MIN_MAPQ, drop_chimeric=True, max_tlen=extraction.MAX_TLEN, min_flanking_base_q=MIN_FLANKING_BASE_Q):
    """(panel, counters) of a sample.

    loci: locus_id, chrom, bed_start, bed_end, ref_orientation, up_flank,
    dn_flank, up_run_side, dn_run_side (reference positions or null), and
    reference_window_status. A locus without flanks, or whose window no read
    gives back, stays in the panel with its status, without rows and counts.
    """
    everywhere = loci
    loci = kept_once(_with_windows(alignments, loci, min_mapq))
    broken = geometry.geometry_violations(loci).select("locus_id").limit(10).collect()
    if broken:
        raise ValueError(f"flanks outside the reference window or crossing: {sorted(r['locus_id'] for r in broken)}")
    everything = kept_once(tested_reads(alignments, loci.drop("window", "window_start", "walk_up", "walk_dn"), min_mapq, drop_chimeric, max_tlen))
    tested = everything.where("drop_reason IS NULL")
    lo, hi = geometry.flanked_interval(F.col("ref_orientation"), F.col("up_run_side"), F.col("dn_run_side"))
    masked = mask_low_quality(F.col("raw"), F.col("qual"), min_flanking_base_q)
    up, dn = al.alignment_sides(masked, F.col("blocks"), lo, hi, F.col("ref_orientation"))
    sided = kept_once(tested.withColumns({"up": up, "dn": dn}))

    # placed once: rows and counters both come from it
    placed = kept_once(placement.place(sided.where("overlaps")))
    mi, strand = extraction.molecule(F.col("mi"))
    at, size = F.col("up_outer"), F.col("dn_outer") - F.col("up_outer") + 1
    quals = F.when(F.col("ref_orientation") == "-", F.reverse("qual")).otherwise(F.col("qual"))
    spanning = placed.where("kept").withColumns({"molecule": mi, "letter": strand}).where("molecule IS NOT NULL").select(
        "locus_id", "qname", "ord", F.lit(True).alias("spans"), F.col("molecule").alias("mi"), F.col("letter").alias("strand"), "tract", "up", "dn",
        F.substring("seq", at + 1, size).alias("stretch"), F.slice(quals, at + 1, size).alias("quals"),
        F.transform(F.sequence(at, F.col("dn_outer")), lambda i: (i > F.col("a")) & (i < F.col("b"))).alias("in_tract"),
    )
    # only names with a spanning mate can become fragments
    names = spanning.select("locus_id", "qname").distinct()
    beside = sided.where("NOT overlaps").join(names, ["locus_id", "qname"], "left_semi").select(
        "locus_id", "qname", "ord", F.lit(False).alias("spans"), F.lit(None).cast("string").alias("mi"), F.lit(None).cast("string").alias("strand"),
        F.lit(None).cast("string").alias("tract"), "up", "dn", F.lit(None).cast("string").alias("stretch"), F.lit(None).cast("array<int>").alias("quals"),
        F.lit(None).cast("array<boolean>").alias("in_tract"),
    )
    found = kept_once(extraction.fragments(spanning.unionByName(beside)))

    # a merged stretch is placed anew with every base marked
    flanks = loci.select("locus_id", "up_flank", "dn_flank")
    whole = F.array(F.struct(F.lit(0).alias("lo"), F.length("merged").alias("hi")))
    again = found.where("merged IS NOT NULL").select("locus_id", "qname", F.col("merged").alias("seq"), whole.alias("marks")).join(flanks, "locus_id")
    again = placement.place(again).where("kept").select("locus_id", "qname", F.col("tract").alias("merged_tract"))
    settled = kept_once(found.join(again, ["locus_id", "qname"], "left").withColumn("tract", F.coalesce("tract", "merged_tract")))

    rows = extraction.panel_rows(settled)
    widths = rows.groupBy("locus_id").agg(
        F.max(F.instr("flanking_seq", "|") - 1).cast("long").alias("up_width"), F.max(F.length("flanking_seq") - F.instr("flanking_seq", "|")).cast("long").alias("dn_width")
    )
    starts = geometry.start_coordinates(F.col("ref_orientation"), lo, hi, F.col("up_width"), F.col("up_run_side").isNotNull(), F.col("dn_run_side").isNotNull())
    tract = geometry.reference_tract(F.col("window"), F.col("window_start"), F.col("ref_orientation"), F.col("up_run_side"), F.col("dn_run_side"))
    shaped = loci.join(widths, "locus_id", "left").fillna(0, ["up_width", "dn_width"]).select(
        "locus_id", "ref_orientation", "up_width", "dn_width", starts[0].alias("up_start"), starts[1].alias("dn_start"), tract.alias("reference_tract"), "walk_up", "walk_dn"
    )
    # loci without geometry keep what is known of them
    status = F.when(F.col("reference_window_status").isin(NO_WINDOW, NO_PAIR), F.col("reference_window_status")).when(F.col("up_width").isNull(), NO_WINDOW)
    panel_loci = everywhere.drop("ref_orientation").join(shaped, "locus_id", "left").select(
        "locus_id", "ref_orientation", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("up_width", "dn_width")],
        *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("up_start", "dn_start")], F.coalesce(status, F.lit(RECOVERED)).alias("reference_window_status"),
        "chrom", "bed_start", "bed_end", "up_flank", "dn_flank", F.coalesce("reference_tract", F.lit("")).alias("reference_tract"),
        F.coalesce(F.array_join(F.transform(run_lengths(F.col("reference_tract")), lambda n: n.cast("string")), ","), F.lit("")).alias("reference_run_lengths"), "walk_up", "walk_dn",
    )

    pairs = settled.groupBy("locus_id").agg(
        F.count("*").alias("n_read_pairs"), F.count_if(F.col("differ") & F.col("tract").isNull()).alias("n_read_pairs_drop_disagree"),
        F.count_if(F.col("differ") & F.col("tract").isNotNull()).alias("n_read_pairs_merged"), F.count("tract").alias("n_reads"),
    )
    counters = extraction.filter_counters(everything, everywhere).join(placement.drop_counters(placed, "locus_id"), "locus_id", "left").join(pairs, "locus_id", "left").fillna(0)
    return Panel(rows, panel_loci), counters
