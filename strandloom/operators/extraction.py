"""From alignments to panel rows: overlap, filters, counters, mates.

alignments: chrom, ord, qname, flag, pos0, end0, mapq, tlen, seq, mi, sa
loci: locus_id, chrom, bed_start, bed_end
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.tract import merge_by_quality, side_consensus

MIN_MAPQ = 40
MAX_TLEN = 1000
#: Unmapped, secondary and supplementary alignments; duplicates and QC failures stay.
DROP_FLAGS = 0x4 | 0x100 | 0x800
#: Width of the position bins that turn the interval join into an equality join.
BIN = 4096


def near_loci(alignments: DataFrame, loci: DataFrame, reach: int = MAX_TLEN) -> DataFrame:
    """Alignments that reach into a locus's fetch window, by an equality join on position bins.

    Both sides are exploded into the bins they cover, which is one or two for
    reads and bounded by the window for loci; a pair is kept in the first bin it
    shares, so nothing is deduplicated afterwards.
    """
    bins = lambda lo, hi: F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))
    low, high = F.greatest(F.col("bed_start") - reach, F.lit(0)), F.col("bed_end") + reach
    windows = loci.withColumns({"fetch_lo": low, "fetch_hi": high}).withColumn("bin", F.explode(bins(F.col("fetch_lo"), F.col("fetch_hi") - 1)))
    reads = alignments.where(F.col("flag").bitwiseAND(DROP_FLAGS) == 0).where("end0 is not null")
    reads = reads.withColumn("bin", F.explode(bins(F.col("pos0"), F.greatest(F.col("end0") - 1, F.col("pos0")))))
    joined = reads.join(windows, ["chrom", "bin"]).where("pos0 < fetch_hi AND end0 > fetch_lo")
    first = F.greatest(F.floor(F.col("pos0") / BIN), F.floor(F.col("fetch_lo") / BIN))
    return joined.where(F.col("bin") == first).drop("bin", "fetch_lo", "fetch_hi")


def filtered(candidates: DataFrame, min_mapq: int = MIN_MAPQ, drop_chimeric: bool = True, max_tlen: int = MAX_TLEN) -> DataFrame:
    """Add overlaps and drop_reason, the first filter that a read fails; null if it passes.

    Reads without a sequence fail silently: no counter knows them.
    """
    overlaps = (F.col("pos0") < F.col("bed_end")) & (F.col("end0") > F.col("bed_start"))
    chimeric = F.col("sa").isNotNull() & F.lit(drop_chimeric)
    reason = (
        F.when(F.col("mapq") < min_mapq, "mapq").when(chimeric, "sa").when(F.abs(F.coalesce("tlen", F.lit(0))) > max_tlen, "tlen")
        .when(F.coalesce(F.length("seq"), F.lit(0)) == 0, "empty").when(overlaps & F.col("mi").isNull(), "no_mi")
    )
    return candidates.withColumn("overlaps", overlaps).withColumn("drop_reason", reason)


def filter_counters(tested: DataFrame, loci: DataFrame) -> DataFrame:
    """Overlapping reads and drops of each locus; loci without reads have zeros."""
    counted = tested.where("overlaps AND NOT drop_reason <=> 'empty'").groupBy("locus_id").agg(
        F.count("*").alias("n_overlap"), *[F.count_if(F.col("drop_reason") == r).alias(f"n_drop_{r}") for r in ("mapq", "sa", "tlen", "no_mi")]
    )
    return loci.select("locus_id").join(counted, "locus_id", "left").fillna(0)


def molecule(mi: Column) -> tuple[Column, Column]:
    """Molecule and strand of an MI tag 'prefix/A' or 'prefix/B'; null for others."""
    good = mi.rlike("^.+/[AB]$")
    return F.when(good, F.regexp_extract(mi, "^(.+)/([AB])$", 1)), F.when(good, F.regexp_extract(mi, "^(.+)/([AB])$", 2))


def fragments(mates: DataFrame) -> DataFrame:
    """One row a fragment from its mates, by query name.

    mates: locus_id, qname, ord, spans (reaches the tract), mi, strand, tract, up,
    dn (sides), and for merging stretch, quals, in_tract. A fragment needs one or
    two mates, at least one that spans, one molecule and one strand. Two different
    tracts are merged by base quality; merged is then the merged stretch, whose
    tract a second placement gives, and null if the merge fails.
    """
    useful = mates.where("spans OR up.bases <> '' OR dn.bases <> ''")
    entry = F.struct("ord", "spans", "mi", "strand", "tract", "up", "dn", "stretch", "quals", "in_tract")
    grouped = useful.groupBy("locus_id", "qname").agg(F.array_sort(F.collect_list(entry), lambda a, b: (a["ord"] > b["ord"]).cast("int") - (a["ord"] < b["ord"]).cast("int")).alias("m"))
    grouped = grouped.where(F.size("m") <= 2)  # an invalid group has more mates; a read name has few
    bed = F.filter("m", lambda x: x["spans"])
    one = lambda name: F.size(F.array_distinct(F.transform("bed", lambda x: x[name]))) == 1
    kept = grouped.withColumn("bed", bed).where((F.size("bed") >= 1) & one("mi") & one("strand"))
    a, b = F.col("bed")[0], F.try_element_at("bed", F.lit(2))
    differ = (F.size("bed") == 2) & (a["tract"] != b["tract"])
    either = F.zip_with(a["in_tract"], b["in_tract"], lambda x, y: x | y)
    merged = F.when(differ, merge_by_quality(a["stretch"], a["quals"], b["stretch"], b["quals"], either))
    mate = lambda side: F.when(F.size("m") == 1, F.col("m")[0][side]).otherwise(side_consensus(F.col("m")[0][side], F.try_element_at("m", F.lit(2))[side]))
    return kept.select(
        "locus_id", "qname", a["mi"].alias("mi"), a["strand"].alias("strand"), F.when(~differ, a["tract"]).alias("tract"), differ.alias("differ"), merged.alias("merged"),
        mate("up").alias("up"), mate("dn").alias("dn"),
    )


def panel_rows(found: DataFrame) -> DataFrame:
    """Fragments to panel rows: flanking strings padded to the locus's widths, then counted."""
    end = lambda s: F.col(f"{s}.start") + F.length(f"{s}.bases")
    kept = found.where("tract is not null")
    widths = kept.groupBy("locus_id").agg(F.max(end("up")).alias("up_width"), F.max(end("dn")).alias("dn_width"))
    dots = lambda n: F.repeat(F.lit("."), n.cast("int"))
    up = F.concat(dots(F.col("up_width") - end("up")), F.reverse("up.bases"), dots(F.col("up.start")))
    dn = F.concat(dots(F.col("dn.start")), F.col("dn.bases"), dots(F.col("dn_width") - end("dn")))
    rows = kept.join(widths, "locus_id").withColumn("flanking_seq", F.concat(up, F.lit("|"), dn))
    return rows.groupBy("locus_id", "mi", "strand", F.col("tract").alias("seq"), "flanking_seq").agg(F.count("*").alias("cnt"))
