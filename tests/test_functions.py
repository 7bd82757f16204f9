"""Scalar functions on hand-computed values."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandloom.functions import alignment as al
from strandloom.functions import tract as fn


def one(spark, column, **values):
    schema = {str: "string", int: "int", list: "array<int>", type(None): "string"}
    names = ", ".join(f"{k} {schema[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], names).select(column).first()[0]


@pytest.mark.parametrize(
    ("seq", "runs", "pattern", "text"),
    [
        ("GGGGGG", [6], [], "-"), ("GGGAGGG", [3, 3], ["A"], "A"), ("GGGTGGG", [3, 3], ["T"], "T"), ("GGGNGGG", [3, 3], ["N"], "N"), ("GGGATGGG", [3, 3], ["AT"], "AT"),
        ("GGGAGGGCGG", [3, 3, 2], ["A", "C"], "A_C"), ("AGGG", [0, 3], ["A"], "A"), ("GGGA", [3, 0], ["A"], "A"), ("", [0], [], "-"),
    ],
)
def test_tracts(spark, seq, runs, pattern, text):
    c = F.col("s")
    assert one(spark, fn.run_lengths(c), s=seq) == runs
    assert one(spark, fn.interrupter_pattern(c), s=seq) == pattern
    assert one(spark, fn.format_pattern(fn.interrupter_pattern(c)), s=seq) == text


def test_small_functions(spark):
    c = F.col
    assert one(spark, fn.reference_run_lengths(c("s")), s="") == []
    assert one(spark, fn.revcomp(c("s")), s="ACGTNacgtn") == "nacgtNACGT"
    assert one(spark, fn.in_tract_orientation(c("s"), c("o")), s="accc", o="-") == "GGGT"
    assert one(spark, fn.orientation(c("s")), s="GC") == "+" and one(spark, fn.orientation(c("s")), s="GCC") == "-"
    assert one(spark, F.struct(*fn.g_walk(c("a"), c("b"))), a="AGG", b="GTG") == (2, 1)
    assert one(spark, fn.tuple_text(c("s"), c("n")), s="GGGAGG", n=2) == "(3, 2)" and one(spark, fn.tuple_text(c("s"), c("n")), s="GGG", n=2) == "—"
    assert one(spark, fn.ref_pos_at_offset(c("o"), F.lit(2000), F.lit(1)), o="-") == 1999
    assert one(spark, fn.offset_at_ref_pos(c("o"), F.lit(2000), F.lit(1998), F.lit(5)), o="-") == 2
    assert one(spark, fn.offset_at_ref_pos(c("o"), F.lit(2000), F.lit(2010), F.lit(5)), o="-") is None
    assert one(spark, fn.format_pattern(F.array(F.lit("ACGTA"), F.lit("C")), 4)) == "AC…TA_C"
    assert one(spark, fn.format_allele(F.array(F.lit("A")), F.array(F.lit(3), F.lit(4)))) == "A:3.4"
    assert [one(spark, fn.significant(F.lit(x))) for x in (0.7, 1.0, 2 / 3, 0.05)] == ["0.7", "1", "0.6667", "0.05"]


def test_sides(spark):
    side = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("bases"))
    assert one(spark, fn.strip_side(F.lit(3), F.lit("..AC.G.."))) == (5, "AC.G")
    assert one(spark, fn.strip_side(F.lit(3), F.lit("..."))) == (0, "")
    assert one(spark, fn.side_consensus(side(0, "AC"), side(0, "GC"))) == (1, "C")
    assert one(spark, fn.side_consensus(side(0, ""), side(2, "AC"))) == (2, "AC")
    assert one(spark, fn.side_consensus(side(0, ""), side(0, ""))) == (0, "")
    assert one(spark, fn.mask_low_quality(F.col("s"), F.col("q"), 20), s="ACG", q=[30, 10, 20]) == "A.G"


@pytest.mark.parametrize(
    ("a", "qa", "b", "qb", "tract", "want"),
    [
        ("AC", [30, 30], "AG", [30, 40], [True, True], "AG"), ("AC", [30, 30], "AG", [30, 30], [True, True], None), ("AC", [30, 30], "AG", [30, 30], [True, False], "AN"),
        ("AC", [30, 30], "ACG", [30, 30, 30], [True, True], None),
    ],
)
def test_quality_merge(spark, a, qa, b, qb, tract, want):
    t = F.array(*map(F.lit, tract))
    assert one(spark, fn.merge_by_quality(F.col("a"), F.col("qa"), F.col("b"), F.col("qb"), t), a=a, qa=qa, b=b, qb=qb) == want


def test_merge_needs_qualities(spark):
    no = F.lit(None).cast("array<int>")
    assert one(spark, fn.merge_by_quality(F.lit("A"), no, F.lit("A"), F.array(F.lit(1)), F.array(F.lit(True)))) is None


def test_alignments(spark):
    blocks = al.aligned_blocks(F.lit("2S3M1I2M2D4M1H"), F.lit(100))
    assert [tuple(b) for b in one(spark, blocks)] == [(2, 100, 3), (6, 103, 2), (8, 107, 4)]
    assert one(spark, al.reference_end(F.lit("2S3M1I2M2D4M1H"), F.lit(100))) == 111
    marks = lambda o: [tuple(m) for m in one(spark, al.bed_marks(blocks, F.lit(102), F.lit(108), F.lit(o), F.lit(12)))]
    assert marks("+") == [(4, 5), (6, 8), (8, 9)] and marks("-") == [(7, 8), (4, 6), (3, 4)]
    at = lambda i, o="+": one(spark, al.reference_coordinate(blocks, F.lit(i), F.lit(o), F.lit(12)))
    assert [at(0), at(2), at(5), at(6), at(11, "-")] == [-1, 100, -1, 103, -1]
    assert one(spark, al.reference_from_md(F.lit("NNACGTTACGT"), F.lit("2S3M1I2M1D3M"), F.lit("1A3^G0C2"), F.lit(5))) == "AAGTAGCGT"
    assert one(spark, al.aligned_blocks(F.lit("2P3M"), F.lit(0)))[0]["q"] == 2


def test_alignment_sides(spark):
    blocks = al.aligned_blocks(F.lit("10M"), F.lit(100))
    up, dn = al.alignment_sides(F.lit("ACGTACGT.A"), blocks, F.lit(102), F.lit(107), F.lit("+"))
    assert one(spark, up) == (0, "CA") and one(spark, dn) == (0, "T.A")
    up, dn = al.alignment_sides(F.lit("ACGTACGT.A"), blocks, F.lit(102), F.lit(107), F.lit("-"))
    assert one(spark, up) == (0, "A.T") and one(spark, dn) == (0, "GT")


def brute_sides(seq, blocks, lo, hi, minus):
    out = []
    for keep, distance in ((lambda r: r < lo, lambda r: lo - 1 - r), (lambda r: r >= hi, lambda r: r - hi)):
        known = {distance(r + k): seq[q + k] for q, r, n in blocks for k in range(n) if keep(r + k) and seq[q + k] != "."}
        text = "".join(known.get(d, ".") for d in range(min(known), max(known) + 1)) if known else ""
        out.append((min(known, default=0), text.translate(str.maketrans("ACGTN", "TGCAN")) if minus else text))
    return out[::-1] if minus else out


def test_alignment_sides_of_long_reads(spark):
    """Against single bases; the time grows with the read, not with a power of it."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        n, size = rng.choice([8, 40, 3000]), rng.randrange(1, 9)
        text, quals = "".join(rng.choice("ACGTN") for _ in range(n)), [rng.choice([10, 30, 30]) for _ in range(n)]
        first, last = n // 4, n // 2
        cigar = f"{first}M{size}{rng.choice('DN')}{last}M1I{n - first - last - 1}M" if k % 2 else f"{first}S{n - first}M"
        lo = rng.choice([0, 90, 102, 100 + n // 2, 100 + 2 * n])
        rows.append((k, text, quals, cigar, lo, rng.choice([lo, lo + 3, lo + n, 1 << 62]), rng.choice("+-")))
    df = spark.createDataFrame(rows, "k int, s string, q array<int>, cigar string, lo long, hi long, o string")
    blocks = al.aligned_blocks(F.col("cigar"), F.lit(100))
    up, dn = al.alignment_sides(fn.mask_low_quality(F.col("s"), F.col("q"), 20), blocks, F.col("lo"), F.col("hi"), F.col("o"))
    began = time.perf_counter()
    got = {r["k"]: r for r in df.select("k", blocks.alias("blocks"), up.alias("up"), dn.alias("dn")).collect()}
    assert time.perf_counter() - began < 60
    for k, text, quals, _, lo, hi, o in rows:
        masked = "".join("." if q < 20 else b for b, q in zip(text, quals, strict=True))
        assert [tuple(got[k]["up"]), tuple(got[k]["dn"])] == brute_sides(masked, [*map(tuple, got[k]["blocks"])], lo, hi, o == "-"), k
