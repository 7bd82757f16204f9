"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, durable

#: Up to this number of edges, joins are left to Spark's size check; files of edges are packed, so beyond it they are merged.
SMALL = 250_000


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest node of each node's component: (node, root), for nodes that have an edge.

    Alternates two contractions until the edges no longer change. Large star
    links a node's larger neighbours to the smallest node about it; small star
    does so with its smaller neighbours. Both keep connectivity, and the fixed
    point is a star about the smallest node of each component. Each step is two
    aggregations by node and one join, so a hub is never gathered into a row,
    and the number of rounds grows with the logarithm of the nodes. Every round
    is written to the shared folder; nothing is held on the driver.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, path = durable(pairs, "edges")
    before, n = None, current.count()
    while True:
        held = (lambda df: df) if n <= SMALL else (lambda df: df.hint("merge"))
        # large star: over both directions, larger neighbours move to the minimum
        both = current.select("u", "v").unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(held(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every edge points from larger to smaller
        down = large.where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(held(least), "u")
        small = (
            linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        ).distinct()
        following, next_path = durable(small, "edges")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(spark, path)
        current, path = following, next_path
        if tuple(state) == before:
            break
        before, n = tuple(state), state[0]
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
