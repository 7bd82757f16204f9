"""Placement and search against a slow reading of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import extraction, flank_search, placement

UP, DN = "ACGTACGTAC", "TGCATGCATG"
SCHEMA = "id int, seq string, marks array<struct<lo:int,hi:int>>, up_flank string, dn_flank string"


def slow_match(read, end, flank):
    """(cost, size) of the cheapest match of flank that ends at a position."""
    def window(n):
        return read[end - n + 1 : end + 1] if end - n + 1 >= 0 else None

    w = window(10)
    if w is not None:
        d = sum(x != y or x == "N" for x, y in zip(w, flank, strict=True))
        if d <= 1:
            return 2 * d, 10
    for g in (1, 2):
        w = window(10 + g)
        if w is not None and any(w[:i] + w[i + g :] == flank for i in range(1, 10)):
            return 3 + g, 10 + g
        w = window(10 - g)
        if w is not None and any(flank[:i] + flank[i + g :] == w for i in range(1, 10 - g)):
            return 3 + g, 10 - g
    return None


def slow_side(read, flank):
    out = {}
    for i in range(len(read) - 1):
        if read[i] != "G" and read[i + 1] == "G" and (m := slow_match(read, i, flank)):
            out[i] = m
    return out


def slow_place(read, up, dn, marks):
    ups = slow_side(read, up)
    dns = {len(read) - 1 - i: m for i, m in slow_side(read[::-1], dn[::-1]).items()}
    best = None
    for a, (ca, _) in ups.items():
        for b, (cb, _) in dns.items():
            if a < b and any(max(lo, a + 1) < min(hi, b) for lo, hi in marks):
                inner = read[a + 1 : b]
                value = sum(2 if x == "G" else -4 for x in inner) - ca - cb
                best = max(best or (-(10**9), 0, 0), (value, a, -b))
    ordered = bool(ups and dns and min(ups) < max(dns))
    kept = best is not None and best[0] >= 0
    return {
        "upstream_matched": bool(ups), "downstream_matched": bool(dns), "placed": best is not None, "kept": kept, "no_placement": bool(ups and dns and not ordered),
        "no_bed_base": bool(ups and dns and ordered and best is None), "negative_value": best is not None and not kept, "value": best[0] if best else 0,
        "a": best[1] if best else -1, "b": -best[2] if best else -1, "tract": read[best[1] + 1 : -best[2]] if kept else None,
    }


def changed(rng, flank):
    kind, i, g = rng.random(), rng.randrange(1, 9), rng.choice((1, 2))
    if kind < 0.3:
        return flank
    if kind < 0.5:
        return flank[:i] + rng.choice("ACGTN") + flank[i + 1 :]
    if kind < 0.7:
        return flank[:i] + "".join(rng.choice("ACGT") for _ in range(g)) + flank[i:]
    return flank[:i] + flank[i + g :]


def random_reads(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        up, dn = (UP, DN) if i % 3 else ("TGGTGGTGGT", "TGGTGGTGGT")
        tract = "".join(rng.choice("GGGGGA") for _ in range(rng.randrange(1, 9)))
        read = "".join(rng.choice("ACGT") for _ in range(rng.randrange(4))) + changed(rng, up) + "G" + tract + "G" + changed(rng, dn) + rng.choice(["", "GT", "GTGCATGCATG", "A"])
        lo = rng.randrange(len(read))
        out.append((i, read, [(lo, lo + rng.randrange(1, 8))], up, dn))
    return [*out, *[(n + i, r, m, u, d) for i, (_, r, m, u, d) in enumerate(out[:20])], (2 * n, "", [], UP, DN), (2 * n + 1, "G", [(0, 1)], UP, DN)]


@pytest.mark.parametrize("seed", [11, 23])
def test_random_reads(spark, seed):
    rows = random_reads(250, seed)
    got = {r["id"]: r.asDict() for r in placement.place(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, read, marks, up, dn in rows:
        want = slow_place(read, up, dn, marks)
        assert {k: got[i][k] for k in want} == want, (read, marks, up, dn)
    assert sum(g["kept"] for g in got.values()) > 40


def test_known_reads(spark):
    rows = [
        (1, "ACTTCAGCTTGACTTACATCATTACCATACAGCAAATTTAAT", [(0, 42)], "ACTTCAGCAT", "CAAATTTTAT"), (2, "G" + DN + "TA" + UP + "GGGG", [(0, 40)], UP, DN),
        (3, UP + "GGGGG" + "TGGTGGTGGTGGT" + "A" * 8, [(10, 15)], UP, "TGGTGGTGGT"), (4, UP + "GGG" + DN, [(0, 3)], UP, DN),
    ]
    got = {r["id"]: r for r in placement.place(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1]["placed"] and not got[1]["kept"] and got[1]["value"] == -80 and got[1]["negative_value"]
    assert got[2]["no_placement"] and got[2]["upstream_matched"] and got[2]["downstream_matched"]
    assert got[3]["tract"] == "GGGGG" and got[4]["no_bed_base"]


def test_counter_relations(spark):
    placed = placement.place(spark.createDataFrame(random_reads(120, 5), SCHEMA)).withColumn("l", F.lit("x"))
    c = placement.drop_counters(placed, "l").first()
    both = placed.where("upstream_matched AND downstream_matched").count()
    assert c["n_placed"] - c["n_drop_negative_value"] == placed.where("kept").count()
    assert c["n_drop_flank"] + placed.where("kept").count() == placed.count()
    assert both == c["n_drop_no_placement"] + c["n_drop_no_bed_base"] + c["n_placed"]


@pytest.mark.parametrize("seed", [13, 29])
def test_pair_search(spark, seed):
    rng = random.Random(seed)
    reads = {}
    for _ in range(14):
        read = rng.choice(["", "CA"]) + changed(rng, UP) + "GGG" + rng.choice(["", "AGG", "T"]) + "GG" + changed(rng, DN) + rng.choice(["", "AC"])
        reads[read] = reads.get(read, 0) + rng.randrange(1, 4)
    df = spark.createDataFrame([("L", r, [(0, len(r))], w) for r, w in reads.items()], "locus_id string, seq string, marks array<struct<lo:int,hi:int>>, weight long")

    def candidates(turn):
        out = set()
        for r in reads:
            s = r[::-1] if turn else r
            facing = [len(s) - 1 - i for i in range(len(s) - 1) if s[::-1][i] != "G" and s[::-1][i + 1] == "G"]
            for i in range(9, len(s) - 1):
                w = s[i - 9 : i + 1]
                if s[i] != "G" and s[i + 1] == "G" and set(w) <= set("ACGT") and w[6:9] != "GGG" and any(i < b <= len(s) - 8 for b in facing):
                    out.add(w[::-1] if turn else w)
        return out

    scores = {(u, v): sum(w * max(0, slow_place(r, u, v, [(0, len(r))])["value"]) for r, w in reads.items()) for u in candidates(False) for v in candidates(True)}
    most = max(scores.values())
    tied = sorted(p for p, s in scores.items() if s == most)
    got = flank_search.best_pairs(df).first()
    assert tuple(got) == ("L", *tied[0], most, len(tied))
    # bounds leave few pairs to score, and hold
    distinct, ups, dns = flank_search.side_matches(df)
    few = flank_search.scored(distinct, *flank_search.reaching(distinct, ups, dns)).count()
    assert len(tied) <= few <= sum(s > 0 for s in scores.values()) / 4
    reach = [{r[c]: r["bound"] for r in flank_search.bounds(m, c).collect()} for m, c in ((ups, "up_flank"), (dns, "dn_flank"))]
    assert all(s <= min(reach[0].get(u, 0), reach[1].get(v, 0)) for (u, v), s in scores.items())


def test_modal_positions(spark):
    schema = "locus_id string, side string, outer_pos long, run_pos long, toward_run int"
    rows = [("a", "up", 4, 10, 1), ("a", "up", 5, 9, 1), ("b", "up", 5, 9, 1), ("b", "up", 4, 9, 1), ("b", "dn", 6, 9, -1), ("b", "dn", 6, 9, -1), ("b", "dn", 1, 1, -1), ("c", "up", None, 3, 1)]
    got = {(r["locus_id"], r["side"]): (r["outer_pos"], r["run_pos"], r["n"]) for r in flank_search.modal_positions(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "up"): (4, 10, 1), ("b", "up"): (5, 9, 1), ("b", "dn"): (6, 9, 2)}


def test_fragments_and_panel_rows(spark):
    side = "struct<start:int,bases:string>"
    schema = f"locus_id string, qname string, ord long, spans boolean, mi string, strand string, tract string, up {side}, dn {side}, stretch string, quals array<int>, in_tract array<boolean>"
    q = [30] * 4
    t = [False, True, True, False]
    none = (0, "")
    rows = [
        ("L", "one", 0, True, "m1", "A", "GG", (0, "AC"), (1, "T"), "AGGT", q, t), ("L", "two", 1, True, "m2", "B", "GG", (0, "AC"), none, "AGGT", q, t),
        ("L", "two", 2, True, "m2", "B", "GA", (0, "GC"), none, "AGAT", [30, 30, 20, 30], t), ("L", "tie", 3, True, "m3", "A", "GG", none, none, "AGGT", q, t),
        ("L", "tie", 4, True, "m3", "A", "GA", none, none, "AGAT", q, t), ("L", "mix", 5, True, "m4", "A", "GG", none, none, "AGGT", q, t),
        ("L", "mix", 6, True, "m5", "A", "GG", none, none, "AGGT", q, t), ("L", "far", 7, True, "m1", "A", "GG", (0, "AC"), (1, "T"), "AGGT", q, t),
        ("L", "far", 8, False, None, None, None, none, (3, "C"), None, None, None), ("L", "off", 9, False, None, None, None, none, (3, "C"), None, None, None),
    ]
    found = extraction.fragments(spark.createDataFrame(rows, schema))
    got = {r["qname"]: r for r in found.collect()}
    assert set(got) == {"one", "two", "tie", "far"} and got["two"]["merged"] == "AGGT" and got["two"]["tract"] is None
    assert got["tie"]["differ"] and got["tie"]["merged"] is None and tuple(got["two"]["up"]) == (1, "C") and tuple(got["far"]["dn"]) == (1, "T.C")
    rows = {(r["mi"], r["flanking_seq"]): r["cnt"] for r in extraction.panel_rows(found).collect()}
    assert rows == {("m1", "CA|.T.."): 1, ("m1", "CA|.T.C"): 1}


def test_molecules(spark):
    df = spark.createDataFrame([("a/A",), ("x/y/B",), ("/A",), ("a/C",), ("a",)], "mi string")
    got = [tuple(r) for r in df.select(*extraction.molecule(F.col("mi"))).collect()]
    assert got == [("a", "A"), ("x/y", "B"), (None, None), (None, None), (None, None)]
