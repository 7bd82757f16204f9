"""Reference windows, flank records and the geometry of loci."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.alignment import reference_from_md
from strandloom.functions.tract import g_walk, orientation, revcomp, window_index
from strandloom.sources.flanks import NO_PAIR, NO_POSITION, NO_WINDOW, RECOVERED

#: Bases of the reference window on each side of the BED interval.
PAD = 50
FAR = 1 << 62


def reference_windows(near: DataFrame, min_mapq: int = 40, pad: int = PAD) -> DataFrame:
    """Reference bases of each locus's window, from the first clean read that spans it.

    near: alignments joined to loci, with end0, cigar, md and sa. A clean read is
    primary, well mapped, not chimeric, has an MD tag and no soft clip.
    """
    lo, hi = F.greatest(F.col("bed_start") - pad, F.lit(0)), F.col("bed_end") + pad
    clean = near.where(
        (F.col("flag").bitwiseAND(0x4 | 0x100 | 0x800) == 0) & (F.col("mapq") >= min_mapq) & F.col("sa").isNull() & F.col("md").isNotNull()
        & ~F.col("cigar").contains("S") & (F.col("pos0") <= lo) & (F.col("end0") >= hi)
    )
    first = clean.groupBy("locus_id", "bed_start", "bed_end").agg(F.min_by(F.struct("pos0", "seq", "cigar", "md"), "ord").alias("r"))
    whole = reference_from_md(F.col("r.seq"), F.col("r.cigar"), F.col("r.md"), F.col("r.pos0"))
    start = F.greatest(F.col("bed_start") - pad, F.lit(0))
    return first.withColumn("whole", whole).select(
        "locus_id", start.alias("window_start"),
        F.expr(f"substring(whole, cast(greatest(bed_start - {pad}, 0) - r.pos0 + 1 as int), cast(bed_end + {pad} - greatest(bed_start - {pad}, 0) as int))").alias("window"),
    )


def reference_walks(windows: DataFrame, loci: DataFrame) -> DataFrame:
    """Orientation of each locus and how far its G run goes on past the BED interval."""
    at = F.expr("cast(bed_start - window_start as int)")
    size = F.expr("cast(bed_end - bed_start as int)")
    joined = loci.join(windows, "locus_id")
    inside = F.substring("window", at + 1, size)
    joined = joined.withColumn("ref_orientation", orientation(inside))
    left, right = F.substring("window", F.lit(1), at), F.substring("window", at + size + 1, F.length("window"))
    minus = F.col("ref_orientation") == "-"
    before, after = F.when(minus, revcomp(right)).otherwise(left), F.when(minus, revcomp(left)).otherwise(right)
    up, dn = g_walk(before, after)
    return joined.withColumns({"walk_up": up, "walk_dn": dn})


def flanked_interval(orient: Column, up_run_side: Column, dn_run_side: Column) -> tuple[Column, Column]:
    """Reference interval [lo, hi) between the two run-side bases; open where a side has no position.

    The upstream side lies low on the plus strand and high on the minus strand.
    """
    minus = orient == "-"
    low, high = F.when(minus, dn_run_side).otherwise(up_run_side), F.when(minus, up_run_side).otherwise(dn_run_side)
    return F.coalesce(low + 1, F.lit(0).cast("long")), F.coalesce(high, F.lit(FAR).cast("long"))


def reference_tract(window: Column, window_start: Column, orient: Column, up_run_side: Column, dn_run_side: Column) -> Column:
    """Reference bases strictly between the run-side bases, in tract orientation; '' if a side has no position."""
    n = F.length(window)
    turned = F.when(orient == "-", revcomp(window)).otherwise(window)
    a, b = window_index(orient, window_start, n, up_run_side), window_index(orient, window_start, n, dn_run_side)
    return F.when(up_run_side.isNull() | dn_run_side.isNull(), "").otherwise(F.substring(turned, (a + 2).cast("int"), F.greatest(b - a - 1, F.lit(0)).cast("int")))


def geometry_violations(loci: DataFrame) -> DataFrame:
    """Loci whose run-side base lies outside the window, or whose upstream side does not come first."""
    n = F.length("window")
    a = window_index(F.col("ref_orientation"), F.col("window_start"), n, F.col("up_run_side"))
    b = window_index(F.col("ref_orientation"), F.col("window_start"), n, F.col("dn_run_side"))
    inside = lambda i: i.isNull() | ((i >= 0) & (i < n))
    return loci.where(~inside(a) | ~inside(b) | (a.isNotNull() & b.isNotNull() & (a >= b)))


def start_coordinates(orient: Column, lo: Column, hi: Column, up_width: Column, up_known: Column, dn_known: Column) -> tuple[Column, Column]:
    """Reference position of the first base of each flanking part; -1 where the side has no position."""
    minus = orient == "-"
    up = F.when(minus, hi + up_width - 1).otherwise(lo - up_width)
    dn = F.when(minus, lo - 1).otherwise(hi)
    none = F.lit(-1).cast("long")
    return F.when(up_known, up).otherwise(none), F.when(dn_known, dn).otherwise(none)


def voted_positions(kept: DataFrame, loci: DataFrame, modal: DataFrame, pad: int = PAD) -> DataFrame:
    """Reference positions of both flanks of each locus, from the vote of its kept reads.

    modal: locus_id, side, outer_pos, run_pos, n, n_positioned. A side without a
    vote, or whose vote lies outside the BED interval's surroundings, has no
    position; sides that cross lose both.
    """
    side = lambda name: modal.where(F.col("side") == name).select(
        "locus_id", *[F.col(c).alias(f"{name}_{c}") for c in ("outer_pos", "run_pos", "n", "n_positioned")]
    )
    joined = loci.join(side("up"), "locus_id", "left").join(side("dn"), "locus_id", "left")
    near = lambda c: (F.col(c) >= F.col("bed_start") - pad) & (F.col(c) < F.col("bed_end") + pad)
    ok = lambda s: near(f"{s}_outer_pos") & near(f"{s}_run_pos")
    toward = F.when(F.col("ref_orientation") == "-", -1).otherwise(1)
    crossing = ok("up") & ok("dn") & (toward * F.col("up_run_pos") >= toward * F.col("dn_run_pos"))
    out = joined
    for s in ("up", "dn"):
        valid = F.coalesce(ok(s), F.lit(False)) & ~F.coalesce(crossing, F.lit(False))
        out = out.withColumn(f"{s}_run_side", F.when(valid, F.col(f"{s}_run_pos"))).withColumn(f"{s}_outer_side", F.when(valid, F.col(f"{s}_outer_pos")))
    return out


def side_table(loci: DataFrame, found: DataFrame, sample: str) -> DataFrame:
    """Two rows for each BED locus, with status, flank and support.

    loci: locus_id, has_window, ref_orientation, n_reads. found: best pairs with
    positions (up_flank, dn_flank, objective in half units, n_tied_pairs,
    n_reads_placed, and for each side run and outer positions and counts).
    """
    joined = loci.join(found, "locus_id", "left")
    status = F.when(~F.col("has_window"), NO_WINDOW).when(F.col("up_flank").isNull(), NO_PAIR)
    rows = []
    for name, s in (("upstream", "up"), ("downstream", "dn")):
        known = F.col(f"{s}_run_side").isNotNull()
        rows.append(
            joined.select(
                F.lit(sample).alias("sample"), F.col("locus_id").alias("locus"), F.lit(name).alias("side"),
                F.coalesce(status, F.when(known, RECOVERED).otherwise(NO_POSITION)).alias("reference_window_status"), "ref_orientation",
                F.when(status.isNull(), F.col(f"{s}_flank")).alias("flank_bases"),
                F.when(status.isNull() & known, F.concat_ws(",", F.col(f"{s}_outer_side"), F.col(f"{s}_run_side"))).alias("flank_ref_positions"),
                F.when(F.col("has_window"), F.coalesce(F.col("objective") / 2, F.lit(0.0))).alias("objective"), "n_reads",
                F.coalesce("n_reads_placed", F.lit(0)).cast("long").alias("n_reads_placed"), F.coalesce("n_tied_pairs", F.lit(0)).cast("long").alias("n_tied_pairs"),
                F.coalesce(f"{s}_n_positioned", F.lit(0)).cast("long").alias("n_reads_positioned"), F.coalesce(f"{s}_n", F.lit(0)).cast("long").alias("n_reads_at_position"),
            )
        )
    return rows[0].unionByName(rows[1])
