"""Family consensus, informative variants, haplotype profiles and row votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.functions.tract import BASES, base_at, ref_pos_at_offset
from strandloom.sources.panel import Panel

MIN_COVERAGE = 25
VAF_MIN = 0.2
MIN_LINKAGE_FAMILIES = 10
MIN_INFORMATIVE = 1
VOTE_MARGIN = 0


def cells(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, flanking offset and character; the separator makes no cell.

    Rows that differ in what is not asked for are added up before the strings are exploded.
    """
    summed = rows.groupBy("locus_id", *keys, "flanking_seq").agg(F.sum("cnt").alias("cnt"))
    out = summed.select("locus_id", *keys, "cnt", F.posexplode(F.split("flanking_seq", "")).alias("offset", "base"))
    return out.where("base <> '|'")


def position_frequencies(rows: DataFrame) -> DataFrame:
    """Reads of A, C, G, T, N and '.' at each offset; other characters count nowhere."""
    sums = [F.sum(F.when(F.col("base") == b, F.col("cnt")).otherwise(0)).alias(f"n_{name}") for b, name in zip([*BASES, "N", "."], [*BASES, "N", "pad"], strict=True)]
    return cells(rows).groupBy("locus_id", "offset").agg(*sums)


#: SQL of a molecule's base at position i of its strings m: the one with most reads, '.' on a tie and without any.
_CALL = """transform(array(array_distinct(filter(transform(m, x -> x.c[i]), b -> b IN ('A', 'C', 'G', 'T')))), d -> CASE size(d) WHEN 0 THEN '.' WHEN 1 THEN d[0] ELSE
  transform(array(transform(d, b -> aggregate(m, 0L, (n, x) -> n + if(x.c[i] = b, x.cnt, 0L)))),
    w -> if(size(filter(w, v -> v = array_max(w))) = 1, d[cast(array_position(w, array_max(w)) as int) - 1], '.'))[0] END)[0]"""


def molecule_calls(rows: DataFrame) -> DataFrame:
    """Consensus string of each molecule: locus_id, mi, calls, with '.' where it calls no base.

    A molecule's rows are the versions of one fragment, so they are folded where
    one shuffle by molecule brings them together, and no cell is ever shuffled.
    """
    entry = F.struct(F.split("flanking_seq", "").alias("c"), F.col("cnt").cast("long").alias("cnt"))
    held = rows.groupBy("locus_id", "mi").agg(F.collect_list(entry).alias("m"))
    alone = F.array_join(F.transform(F.col("m")[0]["c"], lambda b: F.when(b.isin(*BASES), b).otherwise(".")), "")
    folded = F.expr(f"array_join(transform(sequence(0, size(m[0].c) - 1), i -> {_CALL}), '')")
    return held.select("locus_id", "mi", F.when(F.size("m") == 1, alone).otherwise(folded).alias("calls"))


def call_patterns(rows: DataFrame) -> DataFrame:
    """How many molecules have each consensus string: locus_id, calls, n."""
    return molecule_calls(rows).groupBy("locus_id", "calls").agg(F.count("*").alias("n"))


def _called(strings: DataFrame, at: DataFrame | None) -> DataFrame:
    """strings with one row for each offset, or for each in at (locus_id, offset), that has a base."""
    if at is None:
        found = strings.select("*", F.posexplode(F.split("calls", "")).alias("offset", "base"))
    else:
        offsets = at.groupBy("locus_id").agg(F.collect_set(F.col("offset").cast("int")).alias("at"))
        found = strings.join(offsets, "locus_id").withColumn("offset", F.explode("at")).drop("at")
        found = found.withColumn("base", base_at(F.col("calls"), F.col("offset")))
    return found.where(F.col("base").isin(*BASES)).drop("calls")


def family_bases(rows: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Base of each molecule at each offset: the one with most reads, none on a tie. at: (locus_id, offset) to keep."""
    return _called(molecule_calls(rows), at)


def family_counts(patterns: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Molecules that call A, C, G and T at each offset, from their call patterns."""
    counts = [F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(f"fam_{b}") for b in BASES]
    return _called(patterns, at).groupBy("locus_id", "offset").agg(*counts)


def strand_base_counts(rows: DataFrame) -> DataFrame:
    """Reads by strand and molecules by base, at each offset."""
    by_strand = [
        F.sum(F.when((F.col("base") == b) & (F.col("strand") == s), F.col("cnt")).otherwise(0)).alias(f"{s}_{name}")
        for s in ("A", "B") for b, name in zip([*BASES, "N", "."], [*BASES, "N", "pad"], strict=True)
    ]
    reads = cells(rows, "strand").groupBy("locus_id", "offset").agg(*by_strand)
    return reads.join(family_counts(call_patterns(rows)), ["locus_id", "offset"], "left").fillna(0)


def _located(found: DataFrame, loci: DataFrame) -> DataFrame:
    """Add segment, string_index and ref_pos to rows with locus_id and offset."""
    up = F.col("offset") < F.col("up_width")
    index = F.when(up, F.col("offset")).otherwise(F.col("offset") - F.col("up_width") - 1)
    start = F.when(up, F.col("up_start")).otherwise(F.col("dn_start"))
    out = found.join(loci, "locus_id").withColumn("segment", F.when(up, "up").otherwise("dn")).withColumn("string_index", index.cast("long"))
    return out.withColumn("ref_pos", ref_pos_at_offset(F.col("ref_orientation"), start, F.col("string_index"))).drop(*[c for c in loci.columns if c != "locus_id"])


def informative_snvs(panel: Panel, min_coverage: int = MIN_COVERAGE, vaf_min: float = VAF_MIN, patterns: DataFrame | None = None) -> DataFrame:
    """Offsets where the second base has enough molecules; of equal bases the later one ranks first.

    patterns: the panel's call patterns, where they are at hand.
    """
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(F.col(f"fam_{b}").alias("n"), F.lit(b).alias("base")) for b in BASES])))
    coverage = sum((F.col(f"fam_{b}") for b in BASES[1:]), F.col("fam_A"))
    counts = family_counts(call_patterns(panel.rows) if patterns is None else patterns)
    top = counts.select("locus_id", "offset", ranked.alias("r"), coverage.alias("coverage"))
    major, minor = F.col("r")[0], F.col("r")[1]
    vaf = minor["n"].cast("double") / F.col("coverage")
    found = top.where((F.col("coverage") >= min_coverage) & (minor["n"] > 0) & (vaf >= vaf_min)).select(
        "locus_id", "offset", major["base"].alias("allele_major"), minor["base"].alias("allele_minor"), vaf.alias("vaf_minor"), "coverage"
    )
    return _located(found, panel.loci)


def anchored(snvs: DataFrame) -> DataFrame:
    """Mark each locus's anchor: most coverage, then the smallest offset."""
    first = W.partitionBy("locus_id").orderBy(F.desc("coverage"), "offset")
    return snvs.withColumn("is_anchor", F.row_number().over(first) == 1)


def linkage(panel: Panel, snvs: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Molecules that carry the anchor's and a variant's alleles, by combination.

    Both alleles are characters of a call pattern, so each pattern is read once
    with its number of molecules, and no pair of molecules or positions is joined.
    """
    entry = F.struct(F.col("offset").cast("int").alias("offset"), "allele_major", "allele_minor")
    marked = anchored(snvs).groupBy("locus_id").agg(
        F.max(F.when(F.col("is_anchor"), entry)).alias("anchor"), F.collect_list(F.when(~F.col("is_anchor"), entry)).alias("others")
    )

    def allele(s: Column) -> Column:
        base = base_at(F.col("calls"), s["offset"])
        return F.when(base == s["allele_major"], "M").when(base == s["allele_minor"], "m")

    read = (call_patterns(panel.rows) if patterns is None else patterns).join(marked, "locus_id").withColumn("first", allele(F.col("anchor")))
    read = read.where("first is not null").select("locus_id", "calls", "n", "first", F.explode("others").alias("s"))
    read = read.select("locus_id", F.col("s.offset").alias("offset"), "n", "first", allele(F.col("s")).alias("second"))
    combos = {"both_major": ("M", "M"), "both_minor": ("m", "m"), "major_minor": ("M", "m"), "minor_major": ("m", "M")}
    counts = [F.sum(F.when((F.col("first") == a) & (F.col("second") == b), F.col("n")).otherwise(0)).alias(name) for name, (a, b) in combos.items()]
    pairs = read.groupBy("locus_id", "offset").agg(*counts)
    return anchored(snvs).where("NOT is_anchor").select("locus_id", "offset").join(pairs, ["locus_id", "offset"], "left").fillna(0)


def haplotypes(panel: Panel, snvs: DataFrame, min_linkage_families: int = MIN_LINKAGE_FAMILIES, patterns: DataFrame | None = None) -> DataFrame:
    """Variants with status, phase and linkage; a tie of phases is in phase."""
    joined = anchored(snvs).join(linkage(panel, snvs, patterns), ["locus_id", "offset"], "left")
    same, other = F.col("both_major") + F.col("both_minor"), F.col("major_minor") + F.col("minor_major")
    total = same + other
    anchor = F.col("is_anchor")
    phased = anchor | (total >= min_linkage_families)
    flipped = ~anchor & (other > same)
    hap_major = F.when(flipped, F.col("allele_minor")).otherwise(F.col("allele_major"))
    hap_minor = F.when(flipped, F.col("allele_major")).otherwise(F.col("allele_minor"))
    discordance = F.when(anchor, F.lit(0.0)).otherwise(F.least(same, other).cast("double") / total)
    return joined.select(
        "locus_id", "offset", "ref_pos", "segment", "string_index", "allele_major", "allele_minor", "vaf_minor", "coverage",
        F.when(phased, "phased").otherwise("dropped_low_linkage").alias("status"),
        F.when(phased, hap_major).alias("hap_major_base"), F.when(phased, hap_minor).alias("hap_minor_base"),
        F.when(phased, anchor).alias("is_anchor"), F.when(phased, discordance).alias("pair_discordance"),
        F.when(phased, F.when(anchor, F.col("coverage")).otherwise(total)).alias("pair_double_coverage"),
    )


def profiles(phased: DataFrame) -> DataFrame:
    """One row a locus: its phased variants as an array in offset order."""
    entry = F.struct(F.col("offset").cast("int").alias("offset"), "hap_major_base", "hap_minor_base")
    return phased.where("status = 'phased'").groupBy("locus_id").agg(F.array_sort(F.collect_list(entry)).alias("profile"))


def row_votes(rows: DataFrame, profile: DataFrame) -> DataFrame:
    """n_major, n_minor and n_other of every panel row; N counts as other, '.' as nothing."""

    def count(test) -> Column:
        hits = F.filter("profile", lambda s: test(base_at(F.col("flanking_seq"), s["offset"]), s))
        return F.coalesce(F.when(F.col("profile").isNotNull(), F.size(hits)), F.lit(0))

    return rows.join(profile, "locus_id", "left").select(
        *rows.columns,
        count(lambda b, s: b == s["hap_major_base"]).alias("n_major"),
        count(lambda b, s: (b != s["hap_major_base"]) & (b == s["hap_minor_base"])).alias("n_minor"),
        count(lambda b, s: (b != s["hap_major_base"]) & (b != s["hap_minor_base"]) & (b != ".")).alias("n_other"),
    )


def labelled(votes: DataFrame, min_informative: int = MIN_INFORMATIVE, vote_margin: int = VOTE_MARGIN) -> DataFrame:
    """Add phase_label: the side that leads by more than the margin."""
    major, minor = F.col("n_major"), F.col("n_minor")
    enough = major + minor >= min_informative
    return votes.withColumn(
        "phase_label", F.when(enough & (major - minor > vote_margin), "hap_major").when(enough & (minor - major > vote_margin), "hap_minor").otherwise("unk")
    )


def assign(panel: Panel, phased: DataFrame, min_informative: int = MIN_INFORMATIVE, vote_margin: int = VOTE_MARGIN) -> DataFrame:
    return labelled(row_votes(panel.rows, profiles(phased)), min_informative, vote_margin)
