"""Search of the flank pair that explains a locus's reads best.

reads: locus_id, seq, marks, weight; seq in tract orientation. The objective of a
pair is the weighted sum over reads of its best placement value, where positive.
Candidates meet the reads by equality of short keys, never by a product: a
window within one substitution of a candidate shares one of its halves, and a gap
becomes an equality once the surplus bases are left out on the longer side.

Not every pair is scored. In a read, a match can't be worth more than the best
tract from its edge to any facing one, less its cost; summed over reads that
bounds what any pair with this candidate can reach. The exact objective of the
pair of the two highest bounds is a floor, and only candidates whose bound
reaches it are paired. A pair as good as the best has both bounds above the
floor, so neither the best pair nor a tie is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.operators.placement import FLANK, GAP_OPEN, ROOM, SUBSTITUTION, _differences, _window, tract_score, upstream_edges, without
from strandloom.sources.shared import settled


def _turned(reads: DataFrame) -> DataFrame:
    """Reads reversed, with their marks."""
    n = F.length("seq")
    marks = F.transform("marks", lambda m: F.struct((n - m["hi"]).alias("lo"), (n - m["lo"]).alias("hi")))
    return reads.withColumn("marks", marks).withColumn("seq", F.reverse("seq"))


def _usable_edges(reads: DataFrame) -> DataFrame:
    """Edges with room for a match, a mark after them and a facing edge with room behind it."""
    n = F.length("seq")
    facing = F.transform(upstream_edges(F.reverse("seq")), lambda i: n - 1 - i)
    found = reads.withColumn("facing", facing).select("*", F.explode(upstream_edges(F.col("seq"))).alias("end"))
    end = F.col("end")
    marked = lambda b: F.exists("marks", lambda m: F.greatest(m["lo"], end + 1) < F.least(m["hi"], b))
    return found.where((end >= ROOM - 1) & F.exists("facing", lambda b: (b > end) & (b <= n - ROOM) & marked(b))).drop("facing")


def candidates(reads: DataFrame, downstream: bool = False) -> DataFrame:
    """Distinct candidate strings of a side: ten ACGT bases at a usable edge, not three G before it."""
    edges = _usable_edges(_turned(reads) if downstream else reads)
    window = _window(F.col("seq"), F.col("end"), FLANK)
    out = edges.select("locus_id", window.alias("flank")).where(r"flank rlike '^[ACGT]{10}$' AND NOT flank rlike 'GGG.$'").distinct()
    return out.withColumn("flank", F.reverse("flank")) if downstream else out


def _matches(reads: DataFrame, flanks: DataFrame) -> DataFrame:
    """Every match of every candidate at an edge: read, flank, pos, cost."""
    edges = reads.select("locus_id", "read", "seq", F.explode(upstream_edges(F.col("seq"))).alias("end"))
    spots = edges.select("locus_id", "read", "end", _window(F.col("seq"), F.col("end"), FLANK + 2).alias("w12"), *[
        _window(F.col("seq"), F.col("end"), FLANK + d).alias(f"w{FLANK + d}") for d in (1, 0, -1, -2)
    ])
    windows = spots.select("locus_id", "w12", "w11", "w10", "w9", "w8").distinct()
    shape = ["locus_id", "w12", "w11", "w10", "w9", "w8"]

    def keyed(df: DataFrame, keys: Column) -> DataFrame:
        return df.withColumn("key", F.explode(keys))

    half = FLANK // 2
    halves = lambda c: F.array(F.concat(F.lit("0"), F.left(c, F.lit(half))), F.concat(F.lit("1"), F.right(c, F.lit(half))))
    gapped = lambda c, g, last: F.transform(F.sequence(F.lit(1), F.lit(last)), lambda i: without(c, i, g))
    own = windows.where("w10 is not null")
    near = keyed(own, halves(F.col("w10"))).join(keyed(flanks, halves(F.col("flank"))), ["locus_id", "key"])
    found = [near.withColumn("d", _differences(F.col("w10"), F.col("flank"))).where("d <= 1").select(*shape, "flank", (F.col("d") * SUBSTITUTION).alias("cost"))]
    for gap in (1, 2):
        longer, shorter = f"w{FLANK + gap}", f"w{FLANK - gap}"
        more = keyed(windows.where(f"{longer} is not null"), gapped(F.col(longer), gap, FLANK - 1)).join(flanks.withColumn("key", F.col("flank")), ["locus_id", "key"])
        less = windows.where(f"{shorter} is not null").withColumn("key", F.col(shorter)).join(keyed(flanks, gapped(F.col("flank"), gap, FLANK - 1 - gap)), ["locus_id", "key"])
        found += [x.select(*shape, "flank", F.lit(GAP_OPEN + gap).alias("cost")) for x in (more, less)]
    union = found[0]
    for x in found[1:]:
        union = union.unionByName(x)
    least = union.groupBy(*shape, "flank").agg(F.min("cost").alias("cost"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"m.{c}")) for c in shape]
    joined = spots.alias("s").join(least.alias("m"), same)
    return joined.select("s.locus_id", "s.read", F.col("s.end").alias("pos"), "m.flank", "m.cost")


def _distinct(reads: DataFrame) -> DataFrame:
    keys = ["locus_id", "seq", "marks"]
    return reads.groupBy(*keys).agg(F.sum("weight").alias("weight")).withColumn("read", F.sha2(F.to_json(F.struct(*keys)), 256))


def _marked(a, b) -> Column:
    return F.exists("marks", lambda m: F.greatest(m["lo"], a + 1) < F.least(m["hi"], b))


def side_matches(reads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct reads, upstream matches, downstream matches) of all candidates.

    A match has its read, flank, edge, cost and gain: what a read can gain by it at most.
    """
    distinct = _distinct(reads)
    shapes = distinct.select("locus_id", "read", "seq", "marks", "weight")
    ups = _matches(distinct, candidates(reads)).select("locus_id", "read", F.col("flank").alias("up_flank"), F.col("pos").alias("a"), F.col("cost").alias("up_cost"))
    turned = candidates(reads, downstream=True).withColumn("flank", F.reverse("flank"))
    backward = _matches(distinct.withColumn("seq", F.reverse("seq")), turned)
    n = F.length("seq")
    gain = lambda edges, score, cost: F.coalesce(F.array_max(F.transform(edges, score)), F.lit(0)) - cost
    facing = F.transform(upstream_edges(F.reverse("seq")), lambda i: n - 1 - i)
    after = F.filter(facing, lambda b: (b > F.col("a")) & _marked(F.col("a"), b))
    ups = ups.join(shapes, ["locus_id", "read"]).withColumn("gain", gain(after, lambda b: tract_score(F.col("seq"), F.col("a"), b), F.col("up_cost")))
    dns = backward.join(shapes, ["locus_id", "read"]).select(
        *shapes.columns, F.reverse("flank").alias("dn_flank"), (n - 1 - F.col("pos")).alias("b"), F.col("cost").alias("dn_cost")
    )
    before = F.filter(upstream_edges(F.col("seq")), lambda a: (a < F.col("b")) & _marked(a, F.col("b")))
    dns = dns.withColumn("gain", gain(before, lambda a: tract_score(F.col("seq"), a, F.col("b")), F.col("dn_cost")))
    keep = ["locus_id", "read", "weight", "gain"]
    return distinct, ups.where("gain > 0").select(*keep, "up_flank", "a", "up_cost"), dns.where("gain > 0").select(*keep, "dn_flank", "b", "dn_cost")


def scored(distinct: DataFrame, ups: DataFrame, dns: DataFrame) -> DataFrame:
    """Objective of every pair of the matches' flanks with a positive one."""
    pairs = ups.drop("weight", "gain").join(dns.drop("weight", "gain"), ["locus_id", "read"]).where("a < b").join(distinct, ["locus_id", "read"])
    a, b = F.col("a"), F.col("b")
    value = tract_score(F.col("seq"), a, b) - F.col("up_cost") - F.col("dn_cost")
    best = pairs.where(_marked(a, b) & (value > 0)).groupBy("locus_id", "read", "weight", "up_flank", "dn_flank").agg(F.max(value).alias("value"))
    return best.groupBy("locus_id", "up_flank", "dn_flank").agg(F.sum(F.col("weight") * F.col("value")).alias("objective"))


def objectives(reads: DataFrame) -> DataFrame:
    """Objective of every candidate pair with a positive one: locus_id, up_flank, dn_flank, objective."""
    return scored(*side_matches(reads))


def bounds(matches: DataFrame, flank: str) -> DataFrame:
    """What a pair with each candidate can reach at most: locus_id, flank, bound."""
    most = matches.groupBy("locus_id", "read", "weight", flank).agg(F.max("gain").alias("gain"))
    return most.groupBy("locus_id", flank).agg(F.sum(F.col("weight") * F.col("gain")).alias("bound"))


def reaching(distinct: DataFrame, ups: DataFrame, dns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The matches of the candidates whose bound reaches the floor of their locus."""
    limits = [settled(bounds(m, c)) for m, c in ((ups, "up_flank"), (dns, "dn_flank"))]
    first = [b.groupBy("locus_id").agg(F.max_by(c, F.struct("bound", c)).alias(c)) for b, c in zip(limits, ("up_flank", "dn_flank"), strict=True)]
    chosen = [m.join(f, ["locus_id", c], "left_semi") for m, f, c in zip((ups, dns), first, ("up_flank", "dn_flank"), strict=True)]
    floor = settled(scored(distinct, *chosen).select("locus_id", F.col("objective").alias("floor")))
    out = []
    for m, b, c in zip((ups, dns), limits, ("up_flank", "dn_flank"), strict=True):
        kept = b.join(floor, "locus_id", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(0)))
        out.append(m.join(kept.select("locus_id", c), ["locus_id", c], "left_semi"))
    return out[0], out[1]


def best_pairs(reads: DataFrame) -> DataFrame:
    """The best pair of each locus, the first of equal ones, with how many are equal."""
    distinct, ups, dns = map(settled, side_matches(reads))
    found = scored(distinct, *reaching(distinct, ups, dns))
    locus = W.partitionBy("locus_id")
    top = found.withColumn("most", F.max("objective").over(locus)).where("objective = most")
    first = F.min(F.struct("up_flank", "dn_flank"))
    out = top.groupBy("locus_id", "objective").agg(first.alias("pair"), F.count("*").alias("n_tied_pairs"))
    return out.select("locus_id", "pair.up_flank", "pair.dn_flank", "objective", "n_tied_pairs")


def mismatches(placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Loci whose reads, placed with the chosen pair, do not add up to its objective."""
    total = placed.groupBy("locus_id").agg(F.sum(F.greatest("value", F.lit(0))).alias("total"))
    return pairs.join(total, "locus_id", "left").where(F.col("objective") != F.coalesce("total", F.lit(0))).select("locus_id", "objective", "total")


def modal_positions(coordinates: DataFrame) -> DataFrame:
    """Most common (outer, run) coordinates of each group; ties go to those nearest the G run.

    coordinates: locus_id, side, outer, run, toward_run (1 where the run lies at
    larger coordinates, else -1), and weight where a row stands for several.
    """
    n = F.sum("weight") if "weight" in coordinates.columns else F.count("*")
    counts = coordinates.where("outer_pos is not null and run_pos is not null").groupBy("locus_id", "side", "outer_pos", "run_pos", "toward_run").agg(n.alias("n"))
    near = lambda c: F.desc(F.col("toward_run") * F.col(c))
    rank = F.row_number().over(W.partitionBy("locus_id", "side").orderBy(F.desc("n"), near("run_pos"), near("outer_pos")))
    total = F.sum("n").over(W.partitionBy("locus_id", "side"))
    return counts.withColumn("n_positioned", total).withColumn("rank", rank).where("rank = 1").drop("rank", "toward_run")
