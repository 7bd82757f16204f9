"""Flank placement: which part of a read lies between two flanking strings.

All scores and costs are integers in half units. Reads are in tract orientation
and upper case; marks is an array of structs (lo, hi), half-open index ranges of
the bases that count as aligned inside the locus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLANK = 10
ROOM = 8
G_SCORE, OTHER_SCORE = 2, -4
SUBSTITUTION, GAP_OPEN = 2, 3


def upstream_edges(seq: Column) -> Column:
    """Positions of a non-G base right before a G."""
    at = lambda i: F.substring(seq, i + 1, F.lit(1))
    inner = F.filter(F.sequence(F.lit(0), F.greatest(F.length(seq) - 2, F.lit(0))), lambda i: (at(i) != "G") & (at(i + 1) == "G"))
    return F.when(F.length(seq) > 1, inner).otherwise(F.array().cast("array<int>"))


def _window(seq: Column, end: Column, size: int) -> Column:
    """The size bases that end at a position; null where the read begins later."""
    return F.when(end >= size - 1, F.substring(seq, end - size + 2, F.lit(size)))


def _differences(a: Column, b: Column) -> Column:
    marks = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when((x == y) & (x != "N"), 0).otherwise(1))
    return F.aggregate(marks, F.lit(0), lambda n, x: n + x)


def without(text: Column, i: Column, size: int) -> Column:
    """A string without the size bases after its first i."""
    return F.concat(F.left(text, i), F.substring(text, i + size + 1, F.length(text)))


def _left_out(text: Column, gap: int, last: int, other: Column) -> Column:
    """Whether text without some gap inner bases equals another string."""
    return F.exists(F.sequence(F.lit(1), F.lit(last)), lambda i: without(text, i, gap) == other)


def match(seq: Column, end: Column, flank: Column) -> Column:
    """Cheapest match of a flank that ends at a position: struct(cost, size), null without one.

    Nothing differs, or one base, or one gap of one or two bases strictly inside
    the flank. Of equal costs the first in this order sets the size: no gap, then
    for each gap size more read bases before fewer.
    """
    plain = _window(seq, end, FLANK)
    differing = _differences(plain, flank)
    options = [F.when(differing <= 1, F.struct((differing * SUBSTITUTION).alias("cost"), F.lit(FLANK).alias("size")))]
    for gap in (1, 2):
        longer, shorter = _window(seq, end, FLANK + gap), _window(seq, end, FLANK - gap)
        extra = _left_out(longer, gap, FLANK - 1, flank)
        lost = _left_out(flank, gap, FLANK - 1 - gap, shorter)
        for found, size in ((extra, FLANK + gap), (lost, FLANK - gap)):
            options.append(F.when(found, F.struct(F.lit(GAP_OPEN + gap).alias("cost"), F.lit(size).alias("size"))))
    return F.coalesce(*options)


def tract_score(seq: Column, a: Column, b: Column) -> Column:
    """Score of the bases strictly between two positions."""
    inner = F.substring(seq, a + 2, b - a - 1)
    g = F.length(inner) - F.length(F.replace(inner, F.lit("G"), F.lit("")))
    return G_SCORE * g + OTHER_SCORE * (b - a - 1 - g)


def side_matches(reads: DataFrame, downstream: bool) -> DataFrame:
    """All matches of one flank of distinct reads: read, pos, cost, size.

    The downstream side is the upstream side of the reversed read.
    """
    turned = (lambda c: F.reverse(c)) if downstream else (lambda c: c)
    flank = F.col("dn_flank" if downstream else "up_flank")
    edges = reads.select("read", turned(F.col("seq")).alias("s"), turned(flank).alias("f")).select("read", "s", "f", F.explode(upstream_edges(F.col("s"))).alias("end"))
    found = edges.withColumn("m", match(F.col("s"), F.col("end"), F.col("f"))).where("m is not null")
    pos = F.length("s") - 1 - F.col("end") if downstream else F.col("end")
    return found.select("read", pos.alias("pos"), "m.cost", "m.size")


def place(reads: DataFrame) -> DataFrame:
    """Best placement of each read (seq, marks, up_flank, dn_flank), with its drop reasons.

    Equal reads are placed once and joined back. Of equal values the largest
    upstream end wins, then the smallest downstream start.
    """
    strings = ["up_flank", "dn_flank", "seq"]
    keys = [*strings, "marks"]
    # matches and values depend on the strings alone; marks only choose among them
    texts = reads.select(*strings).distinct().withColumn("read", F.sha2(F.to_json(F.struct(*strings)), 256))
    ups = side_matches(texts, False).select("read", F.col("pos").alias("a"), F.col("cost").alias("up_cost"), F.col("size").alias("up_size"))
    dns = side_matches(texts, True).select("read", F.col("pos").alias("b"), F.col("cost").alias("dn_cost"), F.col("size").alias("dn_size"))
    a, b = F.col("a"), F.col("b")
    value = tract_score(F.col("seq"), a, b) - F.col("up_cost") - F.col("dn_cost")
    placements = ups.join(dns, "read").where("a < b").join(texts.select("read", "seq"), "read")
    placements = placements.select("read", F.struct(value.alias("value"), a.alias("a"), (-b).alias("minus_b"), "up_size", "dn_size").alias("p"))
    ends = ups.groupBy("read").agg(F.lit(True).alias("upstream_matched")).join(dns.groupBy("read").agg(F.lit(True).alias("downstream_matched")), "read", "full")
    found = placements.groupBy("read").agg(F.collect_list("p").alias("all"))  # a read has a few
    matched = texts.join(ends, "read", "left").fillna(False).join(found, "read", "left")
    distinct = reads.select(*keys).distinct().join(matched, strings)
    marked = F.filter("all", lambda p: F.exists("marks", lambda m: F.greatest(m["lo"], p["a"] + 1) < F.least(m["hi"], -p["minus_b"])))
    joined = distinct.withColumn("ordered", F.col("all").isNotNull()).withColumn("best", F.array_max(marked))
    both = F.col("upstream_matched") & F.col("downstream_matched")
    placed = F.col("best").isNotNull()
    kept = placed & F.coalesce(F.col("best.value") >= 0, F.lit(False))
    end, start = F.col("best.a"), -F.col("best.minus_b")
    out = joined.select(
        *keys, "upstream_matched", "downstream_matched", placed.alias("placed"), kept.alias("kept"),
        (both & ~F.col("ordered")).alias("no_placement"), (both & F.col("ordered") & ~placed).alias("no_bed_base"), (placed & ~kept).alias("negative_value"),
        F.coalesce("best.value", F.lit(0)).alias("value"), F.coalesce(end, F.lit(-1)).alias("a"), F.coalesce(start, F.lit(-1)).alias("b"),
        F.when(kept, F.substring("seq", end + 2, start - end - 1)).alias("tract"),
        F.when(placed, end - F.col("best.up_size") + 1).alias("up_outer"), F.when(placed, start + F.col("best.dn_size") - 1).alias("dn_outer"),
    )
    return reads.join(out, keys)


def drop_counters(placed: DataFrame, *keys: str) -> DataFrame:
    """The flank counters of each group of placed reads."""
    n = lambda c: F.count_if(c)
    return placed.groupBy(*keys).agg(
        n(F.col("placed")).alias("n_placed"), n(~F.col("kept")).alias("n_drop_flank"), n(~F.col("upstream_matched")).alias("n_drop_upstream"),
        n(~F.col("downstream_matched")).alias("n_drop_downstream"), n(F.col("no_placement")).alias("n_drop_no_placement"),
        n(F.col("no_bed_base")).alias("n_drop_no_bed_base"), n(F.col("negative_value")).alias("n_drop_negative_value"),
    )
