"""From alignments to a panel and to flanks, on hand-made reads."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import geometry, pipeline
from strandloom.sources.alignments import SCHEMA

UP, DN = "ACGTACGTAC", "TGCATGCATG"
LOCI = "locus_id string, chrom string, bed_start long, bed_end long, ref_orientation string, up_flank string, dn_flank string, up_run_side long, dn_run_side long, reference_window_status string"
REF_TRACT = "GGGGGGGAGGGGGG"


def read(qname, tract=REF_TRACT, mi="m/A", mapq=60, tlen=0, sa=None, flag=0, start=40, qual=40, up=UP, dn=DN, before="A" * 10, after="A" * 10, md=None, minus=False):
    seq = before + up + tract + dn + after
    return ("chr1", 0, qname, flag, start, mapq, f"{len(seq)}M", tlen, seq, qual if isinstance(qual, list) else [qual] * len(seq), md, mi, sa)


def alignments(spark, rows):
    return spark.createDataFrame([(r[0], i, *r[2:]) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def loci(spark):
    return spark.createDataFrame([("L", "chr1", 60, 74, "+", UP, DN, 59, 74, "recovered"), ("E", "chr2", 60, 74, "+", UP, DN, 59, 74, "recovered")], LOCI)


#: The read that gives locus L its reference window; it has no molecule.
WHOLE = ("chr1", 0, "whole", 0, 0, 60, "150M", 0, "A" * 50 + UP[:10] + "GGGGGGGAGGGGGG" + DN + "A" * 66, [40] * 150, "150", None, None)


def test_extract(spark, loci):
    other = "GGGGGGAGGGGGGG"
    low = [40] * 54
    low[26] = low[27] = 10
    rows = [
        read("a", mi="m1/A"), read("b", mi="m1/A"), read("c", other, mi="m1/B"), read("d", other, mi="m2/A", tlen=500, start=40),
        read("q", mi="m/A", mapq=10), read("s", mi="m/A", sa="x"), read("t", mi="m/A", tlen=2000), read("n", mi=None), read("sup", flag=2048), read("sec", flag=256),
        read("bad", mi="m3"), read("none", up="A" * 10), read("neither", up="A" * 10, dn="A" * 10), read("neg", "G" + "A" * 12 + "G", mi="m/A"),
        read("pair", REF_TRACT, mi="m4/A", qual=low), read("pair", other, mi="m4/A"), read("tie", REF_TRACT, mi="m5/A"), read("tie", other, mi="m5/A"),
        read("two", mi="m6/A"), read("two", mi="m7/A"), WHOLE,
    ]
    panel, counters = pipeline.extract(alignments(spark, rows), loci)
    got = {(r["mi"], r["strand"], r["seq"]): (r["cnt"], r["flanking_seq"]) for r in panel.rows.collect()}
    side = "A" * 10 + UP + "|" + DN + "A" * 10
    assert got["m1", "A", REF_TRACT][0] == 2 and got["m1", "B", other][0] == 1 and got["m2", "A", other][0] == 1
    assert {k[0] for k in got} == {"m1", "m2", "m4"} and {v[1] for v in got.values()} == {side}
    c = {r["locus_id"]: r.asDict() for r in counters.collect()}
    assert all(v == 0 for k, v in c["E"].items() if k != "locus_id")
    x = c["L"]
    assert (x["n_overlap"], x["n_drop_mapq"], x["n_drop_sa"], x["n_drop_tlen"], x["n_drop_no_mi"]) == (19, 1, 1, 1, 2)
    assert (x["n_drop_upstream"], x["n_drop_downstream"], x["n_drop_negative_value"]) == (2, 1, 1)
    assert x["n_overlap"] == x["n_drop_mapq"] + x["n_drop_sa"] + x["n_drop_tlen"] + x["n_drop_no_mi"] + x["n_placed"] + x["n_drop_flank"] - x["n_drop_negative_value"]
    assert x["n_read_pairs"] == 6 and x["n_reads"] == x["n_read_pairs"] - x["n_read_pairs_drop_disagree"]
    assert x["n_read_pairs_merged"] + x["n_read_pairs_drop_disagree"] == 2
    g = {r["locus_id"]: r for r in panel.loci.collect()}
    assert (g["L"]["up_width"], g["L"]["dn_width"], g["L"]["up_start"], g["L"]["dn_start"]) == (20, 20, 40, 74) and g["E"]["up_width"] == 0
    assert (g["L"]["reference_window_status"], g["L"]["reference_tract"], g["E"]["reference_window_status"]) == ("recovered", REF_TRACT, "ref_window_unrecoverable")


def test_broken_flank_table(spark):
    crossing = spark.createDataFrame([("L", "chr1", 60, 74, "+", UP, DN, 75, 59, "recovered")], LOCI)
    with pytest.raises(ValueError, match="'L'"):
        pipeline.extract(alignments(spark, [read("a"), WHOLE]), crossing)


def test_flanking_mate(spark, loci):
    rows = [read("a", mi="m/A"), ("chr1", 0, "a", 0, 120, 60, "4M", 0, "CATG", [40, 5, 40, 40], None, None, None), ("chr1", 0, "z", 0, 120, 60, "4M", 0, "CATG", [40] * 4, None, None, None), WHOLE]
    panel, _ = pipeline.extract(alignments(spark, rows), loci)
    r = panel.rows.first()
    assert panel.rows.count() == 1 and r["flanking_seq"].split("|")[1] == DN + "A" * 10 + "." * 26 + "C.TG"


def test_build_flanks(spark):
    ref = "A" * 50 + UP + REF_TRACT + DN + "A" * 66
    rows = [read(f"r{i}", mi=f"m{i}/A", start=40) for i in range(6)]
    rows.append(("chr1", 0, "whole", 0, 0, 60, "150M", 0, ref[:150], [40] * 150, "150", "w/A", None))
    beds = spark.createDataFrame([("L", "chr1", 60, 74), ("N", "chr1", 5_000, 5_014)], "locus_id string, chrom string, bed_start long, bed_end long")
    got = {(r["locus"], r["side"]): r.asDict() for r in pipeline.build_flanks(alignments(spark, rows), beds, "s").collect()}
    up, dn = got["L", "upstream"], got["L", "downstream"]
    assert up["reference_window_status"] == "recovered" and up["n_reads"] == up["n_reads_placed"] == 7 and up["ref_orientation"] == "+"
    assert (up["flank_ref_positions"], dn["flank_ref_positions"]) == ("50,59", "83,74") and (up["flank_bases"], dn["flank_bases"]) == (UP, DN)
    assert up["objective"] == 7 * (13 - 2) and up["n_tied_pairs"] >= 1 and up["n_reads_at_position"] == 7
    assert got["N", "upstream"]["reference_window_status"] == got["N", "downstream"]["reference_window_status"] == "ref_window_unrecoverable"


def test_geometry(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert tuple(one(F.struct(*geometry.flanked_interval(lit("+"), lit(59), lit(74))))) == (60, 74)
    assert tuple(one(F.struct(*geometry.flanked_interval(lit("-"), lit(74), lit(59))))) == (60, 74)
    none = F.lit(None).cast("long")
    assert tuple(one(F.struct(*geometry.flanked_interval(lit("+"), none, none)))) == (0, 1 << 62)
    assert one(geometry.reference_tract(lit("AACGGGTT"), lit(100), lit("+"), lit(102), lit(106))) == "GGG"
    assert one(geometry.reference_tract(lit("AACCCTTT"), lit(100), lit("-"), lit(105), lit(101))) == "GGG"
    assert one(geometry.reference_tract(lit("AACGGGTT"), lit(100), lit("+"), none, lit(106))) == ""
    starts = lambda o: tuple(one(F.struct(*geometry.start_coordinates(lit(o), lit(60), lit(74), lit(20), lit(True), lit(True)))))
    assert starts("+") == (40, 74) and starts("-") == (93, 59)
    loci = spark.createDataFrame([("ok", "+", "A" * 10, 100, 102, 106), ("out", "+", "A" * 10, 100, 102, 110), ("cross", "+", "A" * 10, 100, 106, 102)],
                                 "locus_id string, ref_orientation string, window string, window_start long, up_run_side long, dn_run_side long")
    assert {r["locus_id"] for r in geometry.geometry_violations(loci).collect()} == {"out", "cross"}
