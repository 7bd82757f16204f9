"""Column functions on tract strings, flanking strings and reference offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def run_lengths(seq: Column) -> Column:
    """Lengths of the G runs between maximal non-G stretches; edge zeros stay, '' gives [0]."""
    return F.transform(F.split(seq, "[^G]+", -1), lambda x: F.length(x))


def reference_run_lengths(seq: Column) -> Column:
    """Run lengths of a reference tract; an empty tract has none."""
    return F.when(seq == "", F.array().cast("array<int>")).otherwise(run_lengths(seq))


def interrupter_pattern(seq: Column) -> Column:
    """The non-G stretches of a tract, in order."""
    return F.regexp_extract_all(seq, F.lit("([^G]+)"), 1)


def format_pattern(pattern: Column, max_token: int | None = None) -> Column:
    """'-' without interrupters, else the tokens joined by '_'; long tokens as first2…last2."""
    if max_token is not None:
        short = lambda t: F.concat(F.left(t, F.lit(2)), F.lit("…"), F.right(t, F.lit(2)))
        pattern = F.transform(pattern, lambda t: F.when(F.length(t) > max_token, short(t)).otherwise(t))
    return F.when(F.size(pattern) == 0, "-").otherwise(F.array_join(pattern, "_"))


def format_allele(pattern: Column, lengths: Column) -> Column:
    """pattern:len.len"""
    return F.concat_ws(":", format_pattern(pattern), F.array_join(F.transform(lengths, lambda n: n.cast("string")), "."))


def format_genotype(alleles: Column) -> Column:
    return F.array_join(alleles, "/")


def tuple_text(seq: Column, n_runs: Column) -> Column:
    """'(l1, l2)' if the tract has n_runs runs, else a dash; one run keeps its comma."""
    runs = F.transform(run_lengths(seq), lambda n: n.cast("string"))
    body = F.when(F.size(runs) == 1, F.concat(F.element_at(runs, 1), F.lit(","))).otherwise(F.array_join(runs, ", "))
    return F.when(F.size(runs) == n_runs, F.concat(F.lit("("), body, F.lit(")"))).otherwise("—")


def revcomp(seq: Column) -> Column:
    """Reverse complement of A, C, G, T and N, keeping case."""
    return F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan"))


def in_tract_orientation(seq: Column, orientation: Column) -> Column:
    """Upper case; reverse complement where the tract lies on the minus strand."""
    return F.when(orientation == "-", F.upper(revcomp(seq))).otherwise(F.upper(seq))


def orientation(interval: Column) -> Column:
    """'+' if the reference interval has at least as many G as C."""
    count = lambda b: F.length(interval) - F.length(F.replace(interval, F.lit(b), F.lit("")))
    return F.when(count("G") >= count("C"), "+").otherwise("-")


def g_walk(before: Column, after: Column) -> tuple[Column, Column]:
    """Number of G that go on past each end of the interval, in tract orientation."""
    return F.length(F.regexp_extract(before, "G*$", 0)), F.length(F.regexp_extract(after, "^G*", 0))


def ref_pos_at_offset(orientation: Column, start: Column, index: Column) -> Column:
    return F.when(orientation == "-", start - index).otherwise(start + index)


def offset_at_ref_pos(orientation: Column, start: Column, pos: Column, width: Column) -> Column:
    """Index of a reference position in a segment; null outside of it."""
    index = F.when(orientation == "-", start - pos).otherwise(pos - start)
    return F.when((index >= 0) & (index < width), index)


def window_index(orientation: Column, window_start: Column, window_length: Column, pos: Column) -> Column:
    """Index of a reference position in the reference window, in tract orientation."""
    return F.when(orientation == "-", window_start + window_length - 1 - pos).otherwise(pos - window_start)


def base_at(flanking_seq: Column, offset: Column) -> Column:
    return F.substring(flanking_seq, offset + 1, F.lit(1))


def strip_side(start: Column, bases: Column) -> Column:
    """A flanking side without uninformative ends: struct(start, bases); nothing left is (0, '')."""
    lead = F.length(F.regexp_extract(bases, r"^\.*", 0))
    kept = F.btrim(bases, F.lit("."))
    return F.struct(F.when(kept == "", 0).otherwise(start + lead).cast("int").alias("start"), kept.alias("bases"))


def mask_low_quality(seq: Column, qual: Column, least: int) -> Column:
    """Bases below the quality floor become '.'; without qualities all stay."""
    masked = F.array_join(F.zip_with(F.split(seq, ""), qual, lambda b, q: F.when(q < least, ".").otherwise(b)), "")
    return F.when(qual.isNull() | (seq == ""), seq).otherwise(masked)


def side_consensus(a: Column, b: Column) -> Column:
    """Two sides (start, bases): agreement and single coverage stay, disagreement is '.'."""
    padded = lambda s: F.concat(F.repeat(F.lit("."), s["start"]), s["bases"])
    width = F.greatest(F.length(padded(a)), F.length(padded(b)))
    chars = lambda s: F.split(F.rpad(padded(s), width, "."), "")
    one = lambda x, y: F.when((x == y) | (y == "."), x).when(x == ".", y).otherwise(".")
    merged = F.when(width == 0, "").otherwise(F.array_join(F.zip_with(chars(a), chars(b), one), ""))
    return strip_side(F.lit(0), merged)


def merge_by_quality(a: Column, qa: Column, b: Column, qb: Column, in_tract: Column) -> Column:
    """One string of two readings: the higher quality wins at each base.

    in_tract: array of booleans, true where a position lies inside either tract.
    An equal-quality disagreement is N outside and makes the whole result null
    inside. Readings of unequal length or without qualities give null.
    """
    base = lambda p: (
        F.when((p["x"] == p["y"]) | (p["q"] > p["r"]), p["x"]).when(p["q"] < p["r"], p["y"]).when(~p["t"], "N")
    )
    chars = lambda s: F.split(s, "")
    zipped = F.arrays_zip(chars(a).alias("x"), qa.alias("q"), chars(b).alias("y"), qb.alias("r"), in_tract.alias("t"))
    merged = F.transform(zipped, base)
    usable = (F.length(a) == F.length(b)) & qa.isNotNull() & qb.isNotNull()
    return F.when(usable & (F.length(a) == 0), "").when(usable & ~F.exists(merged, lambda c: c.isNull()), F.array_join(merged, ""))


def significant(x: Column, digits: int = 4) -> Column:
    """A share written with so many significant digits, without trailing zeros."""
    text = F.format_string(f"%.{digits}f", x)
    for i in range(1, 8):
        text = F.when(x < 10.0**-i, F.format_string(f"%.{digits + i}f", x)).otherwise(text)
    return F.regexp_replace(text, r"\.?0+$", "")
