"""Phasing on small hand-computed panels."""

import pytest
from pyspark.sql import functions as F

from strandloom.operators import patterns, phasing, tables
from strandloom.sources.panel import Panel

ROWS = "locus_id string, mi string, strand string, seq string, cnt long, flanking_seq string"
LOCI = "locus_id string, ref_orientation string, up_width long, dn_width long, up_start long, dn_start long"


def panel_of(spark, rows, up, dn, orientation="+", up_start=1000, dn_start=2000):
    return Panel(spark.createDataFrame([("L", *r) for r in rows], ROWS), spark.createDataFrame([("L", orientation, up, dn, up_start, dn_start)], LOCI))


def families(spark, strings, up, dn, seqs=None, **geometry):
    rows, i = [], 0
    for s, n in strings.items():
        for _ in range(n):
            rows.append((f"M{i}", "A", (seqs or {}).get(s, "GGGGGG"), 1, s))
            i += 1
    return panel_of(spark, rows, up, dn, **geometry)


def labels(phased):
    got = phased.rows.select("flanking_seq", "phase_label", "n_major", "n_minor", "n_other").distinct().collect()
    return {r[0]: tuple(r)[1:] for r in got}


def profile(phased, panel):
    r = tables.locus_summary(panel, phased).first()
    return r["hap_major_profile"], r["hap_minor_profile"], r["max_discordance"]


def test_position_counts(spark):
    p = panel_of(spark, [("a", "A", "G", 10, "AA|CCG"), ("b", "A", "G", 20, "AT|CCG"), ("c", "A", "G", 5, "AT|CCC"), ("d", "A", "G", 4, "A-|CC.")], 2, 3)
    got = {r["offset"]: r for r in phasing.position_frequencies(p.rows).collect()}
    assert got[0]["n_A"] == 39 and got[1]["n_A"] == 10 and got[1]["n_T"] == 25 and got[5]["n_G"] == 30 and got[5]["n_C"] == 5 and got[5]["n_pad"] == 4
    assert 2 not in got and sum(got[1][f"n_{b}"] for b in ("A", "C", "G", "T", "N", "pad")) == 35


def test_family_ties_abstain(spark):
    p = panel_of(spark, [("m", "A", "G", 4, "AT|CG"), ("m", "B", "G", 4, "AA|CG"), ("k", "A", "G", 2, "AT|CG"), ("k", "B", "G", 3, "AC|CG")], 2, 2)
    got = {(r["mi"], r["offset"]): r["base"] for r in phasing.family_bases(p.rows).collect()}
    assert ("m", 1) not in got and got["m", 0] == "A" and got["k", 1] == "C"


def test_strand_counts(spark):
    p = panel_of(spark, [("m", "A", "G", 4, "AT|C"), ("m", "B", "G", 8, "AC|."), ("k", "A", "G", 2, "AT|C")], 2, 1)
    r = {x["offset"]: x for x in phasing.strand_base_counts(p.rows).collect()}
    assert (r[1]["A_T"], r[1]["B_C"], r[1]["fam_C"], r[1]["fam_T"]) == (6, 8, 1, 1) and r[3]["B_pad"] == 8


@pytest.mark.parametrize(("strings", "want"), [({"AT|CG": 60, "CT|CG": 30, "GT|CG": 10}, ("A", "C", 100, 0.3)), ({"AT|CG": 15, "CT|CG": 15}, ("C", "A", 30, 0.5))])
def test_alleles(spark, strings, want):
    r = phasing.informative_snvs(families(spark, strings, 2, 2)).first()
    assert (r["allele_major"], r["allele_minor"], r["coverage"], r["vaf_minor"]) == want


def test_reverse_position(spark):
    p = families(spark, {"A|TC": 30, "A|TG": 20}, 1, 2, orientation="-")
    r = phasing.informative_snvs(p).first()
    assert (r["ref_pos"], r["segment"], r["string_index"]) == (1999, "dn", 1)


def test_flip_and_discordance(spark):
    p = families(spark, {"CT|GG": 30, "GA|GG": 30, "CA|GG": 20, "GT|GG": 10}, 2, 2)
    a, i, d = profile(tables.phase(p), p)
    assert {a, i} == {"CT", "GA"} and d == pytest.approx(30 / 90)
    p = families(spark, {"CA|GG": 60, "GT|GG": 30, "CT|GG": 5, "GA|GG": 5}, 2, 2)
    phased = tables.phase(p)
    assert profile(phased, p) == ("CA", "GT", pytest.approx(0.1))
    assert {r["pair_double_coverage"] for r in phased.snvs.collect()} == {100}


def test_reads_do_not_count_as_molecules(spark):
    rows = [(f"M{i}", "A", "G", 5, "C|T" if i < 20 else "G|T") for i in range(30)]
    p = panel_of(spark, rows, 1, 1)
    assert phasing.informative_snvs(p, 31).count() == 0 and phasing.informative_snvs(p, 30).first()["coverage"] == 30


def test_low_linkage_is_dropped(spark):
    p = families(spark, {"C.|": 40, ".A|": 40, "CA|": 5, "G.|": 15, ".G|": 15, "GG|": 3}, 2, 0)
    got = {r["offset"]: r for r in tables.snv_calls(tables.phase(p)).join(tables.phase(p).snvs.select("string_index", "offset"), "string_index").collect()}
    assert got[0]["status"] == "phased" and got[0]["is_anchor"] and (got[0]["hap_major_base"], got[0]["hap_minor_base"]) == ("C", "G")
    assert got[1]["status"] == "dropped_low_linkage" and got[1]["hap_major_base"] is None and got[1]["pair_discordance"] is None and got[1]["is_anchor"] is None


def test_votes(spark):
    assert labels(tables.phase(families(spark, {"CA|TT": 70, "GG|TT": 30, "CT|TT": 10}, 2, 2)))["CT|TT"] == ("hap_major", 1, 0, 1)
    assert labels(tables.phase(families(spark, {"CA|TT": 70, "GG|TT": 30, "CG|TT": 50}, 2, 2)))["CG|TT"] == ("unk", 1, 1, 0)
    p = families(spark, {"CA|TG": 100, "GG|AG": 80, "CA|AG": 30}, 2, 2)
    assert labels(tables.phase(p))["CA|AG"] == ("hap_major", 2, 1, 0) and labels(tables.phase(p, vote_margin=1))["CA|AG"][0] == "unk"
    assert labels(tables.phase(families(spark, {"CA|TT": 70, "GG|TT": 30, "CN|TT": 5}, 2, 2)))["CN|TT"] == ("hap_major", 1, 0, 1)
    assert labels(tables.phase(families(spark, {"CA|TT": 5}, 2, 2)))["CA|TT"] == ("unk", 0, 0, 0)


def test_summary(spark):
    p = families(spark, {"CA|TT": 70, "GG|TT": 30}, 2, 2, seqs={"CA|TT": "GGGAGGG"})
    r = tables.locus_summary(p, tables.phase(p)).first()
    assert r["admitted_patterns"] == "A:0.7;-:0.3" and (r["reads_total"], r["reads_major"], r["reads_minor"], r["reads_unk"]) == (100, 70, 30, 0)
    assert r["phase_interrupter_concordance_major"] == r["phase_interrupter_concordance_minor"] == 1.0 and r["n_anchor_families"] == 100
    rows = [(f"M{i}", "A", "GGGGGG" if i < 2 or i >= 70 else "GGGAGGG", 1, "CA|TT" if i < 70 else "GG|TT") for i in range(100)]
    p = panel_of(spark, rows, 2, 2)
    r = tables.locus_summary(p, tables.phase(p)).first()
    assert r["phase_interrupter_concordance_major"] == pytest.approx(68 / 70) and r["phase_interrupter_concordance_minor"] == 1.0


def test_patterns(spark):
    rows = [("1", "A", "GGGAGG", 2, "A|"), ("1", "B", "GGGG", 2, "A|"), ("2", "A", "GGAGG", 3, "A|"), ("2", "B", "GGGG", 1, "A|"), ("3", "A", "GGG", 1, "A|"),
            ("4", "A", "GATG", 1, "A|"), ("4", "B", "GAGCG", 1, "A|")]
    got = {r["mi"]: r["pattern"] for r in patterns.majority_patterns(panel_of(spark, rows, 1, 0).rows).collect()}
    assert got == {"1": [], "2": ["A"], "3": [], "4": ["A", "C"]}
    shares = patterns.pattern_shares(patterns.majority_patterns(panel_of(spark, rows[:5], 1, 0).rows))
    assert {tuple(r["pattern"]): round(r["share"], 4) for r in shares.collect()} == {(): 0.6667, ("A",): 0.3333}


def test_phasing_by_reference(spark):
    reference = families(spark, {"TTTTATT|": 70, "TTTTCTT|": 30}, 7, 0, up_start=1000)
    snvs = tables.phase(reference).snvs
    assert [r["ref_pos"] for r in snvs.collect()] == [1004]
    target = families(spark, {"TTTTTTATT|": 25, "TTTTTTCTT|": 15, "TTTTTT.TT|": 5}, 9, 0, up_start=998)
    phased = tables.phase_by_reference(target, snvs)
    r = tables.snv_calls(phased).first()
    assert (r["segment"], r["string_index"], r["ref_pos"], r["coverage"], r["pair_discordance"], r["pair_double_coverage"]) == ("up", 6, 1004, 40, None, None)
    s = tables.ref_phasing_summary(target, phased).first()
    assert (s["n_usable_snvs"], s["reads_major"], s["reads_minor"], s["reads_unk"], s["n_families"], s["n_families_labeled"]) == (1, 25, 15, 5, 45, 40)
    other = families(spark, {"TTTTATT|": 1, "TTTTCTT|": 1, "TTTT.TT|": 1, "TTTTGTT|": 1}, 7, 0)
    got = labels(tables.phase_by_reference(other, snvs))
    assert [got[s][0] for s in ("TTTTATT|", "TTTTCTT|", "TTTT.TT|", "TTTTGTT|")] == ["hap_major", "hap_minor", "unk", "unk"] and got["TTTTGTT|"][3] == 1
    away = families(spark, {"AA|": 3}, 2, 0, up_start=5000)
    none = tables.phase_by_reference(away, snvs)
    assert none.snvs.count() == 0 and none.rows.where(F.col("phase_label") != "unk").count() == 0
