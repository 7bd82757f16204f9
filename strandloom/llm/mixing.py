"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every document falls into a block of its source, chosen by a hash of its id,
text and source, and every round goes through a source's blocks in a permutation
of its own. A source's quota is a whole number of block draws: as many rounds
over all of its blocks as fit its target, then the first blocks of one more
round, the last of them cut at the document that brings the words nearest to the
target.

The tree hands those quotas to the output shards. Its root holds the quota of
every source; a node passes to its left half a multivariate-hypergeometric draw
of its blocks, and the rest to the right half, down to single shards. The draws
are exact, so the shards' quotas add up to the sources'. Shards then take
disjoint, consecutive ranges of each source's permuted draws, and rows are
shuffled inside a shard by a hash.

The blocks' words, the documents' placement and the draws are distributed; the
driver only holds the number of sources and of shards. All draws are keyed by a
seed and by the names of what is drawn, so a rerun or a recomputed task gives
the same mix.

Defined results
    null or blank text   size 0; drawn with its block, and adds no words
    null source          a source of its own, ordered last
    null or repeated id  the text and the source tell rows apart
    repeated rows        each is drawn on its own: rows alike in id, text and source are
                         numbered, and which of them has which number does not matter
    very long text       counted whole; a block holds it whole
    ties                 broken by the hash order of block and document
    no words at all      every target is 0 and nothing is taken
    empty table          empty result
    clashing columns     only the named columns are read; others pass through mix()
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandloom.llm.common import durable

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 20
#: Words a block holds on average, in a corpus of up to MOST_BLOCKS of them; beyond, blocks grow.
BLOCK_WORDS = 20_000
#: The exact draws take fewer than a billion blocks; a mix draws up to three times each.
MOST_BLOCKS = 100_000_000
#: Words an output shard holds on average.
SHARD_WORDS = 1_000_000
#: Rows a block holds on average at most.
BLOCK_ROWS = 2_000
#: Blocks in one part of the two-level running sum over a source's blocks.
PART_BLOCKS = 256
#: Multipliers of the rounds' block permutations: primes above any number of blocks.
STRIDES = (1_000_000_007, 2_147_483_647, 1_000_000_009, 1_999_999_973)

_WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Add the target words of each source, by filling up to the caps.

    sizes: source, source_size. All words are shared by weight; a source whose
    share is above its cap gets the cap, and what it leaves is shared among the
    others by weight until none is above. Sources are ordered by code point
    (Spark compares UTF-8 bytes, which is the same order), null last.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    weighted, _ = durable(weighted.withColumn("cap", F.col("source_size") * most), "mix-sources")
    share = 0.0
    capped_before = -1
    while True:
        full = F.col("weight") * F.lit(share) >= F.col("cap") if share else F.lit(False)
        row = weighted.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("left"),
            F.sum(F.when(full, 1).otherwise(0)).alias("capped"),
        ).first()
        if not row["all"] or row["capped"] == capped_before or not row["left"]:
            break
        capped_before = row["capped"]
        share = (row["all"] - row["given"]) / row["left"]
    return weighted.withColumn("target", F.least(F.col("weight") * F.lit(share), F.col("cap").cast("double"))).select(
        "source", "source_size", "target"
    )


def _unit(*parts: Column) -> Column:
    return F.xxhash64(*parts, F.lit(SEED))


def permuted(block: str, blocks: str, round_: Column) -> Column:
    """Position of a block in a round's permutation of a source's blocks."""
    stride = F.element_at(F.array(*[F.lit(x).cast("long") for x in STRIDES]), (round_ % len(STRIDES) + 1).cast("int"))
    return F.pmod(F.col(block) * stride, F.col(blocks))


def _split(node: str, quotas: np.ndarray, left: int, seed: int) -> np.ndarray:
    """Blocks of each source that go left: an exact multivariate-hypergeometric draw."""
    key = np.random.SeedSequence([seed, *node.encode()])
    rng = np.random.Generator(np.random.PCG64(key))
    out = np.zeros_like(quotas)
    rest, want = int(quotas.sum()), left
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        out[i] = rng.hypergeometric(q, rest, want) if want else 0
        want -= int(out[i])
    return out


def split_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Exact draws of every shard: (shard, start, quotas), arrays in source order.

    quotas: one row with an array column quotas. Each level of the tree is one
    pass that turns a node into its halves; start holds the draws of each
    source that the shards before have taken.
    """
    schema = "low long, high long, start array<long>, quotas array<long>"

    def halve(batches):
        for batch in batches:
            rows = []
            for low, high, start, held in batch.itertuples(index=False):
                if high - low <= 1:
                    rows.append((low, high, start, held))
                    continue
                middle = (low + high) // 2
                start, held = np.asarray(start, dtype=np.int64), np.asarray(held, dtype=np.int64)
                want = int(held.sum()) * (middle - low) // (high - low)
                left = _split(f"{low}:{high}", held, want, seed)
                rows += [(low, middle, start, left), (middle, high, start + left, held - left)]
            yield pd.DataFrame(rows, columns=["low", "high", "start", "quotas"])

    zero = F.lit(0).cast("long")
    nodes = quotas.select(
        zero.alias("low"), F.lit(shards).cast("long").alias("high"), F.transform("quotas", lambda _: zero).alias("start"), "quotas"
    )
    for level in range(math.ceil(math.log2(max(shards, 1)))):
        nodes = nodes.mapInPandas(halve, schema)
        if level % 6 == 5:  # spread the nodes that are left
            nodes, _ = durable(nodes.repartition(2 ** min(level, 12), "low"), "mix-tree")
    return nodes.select(F.col("low").alias("shard"), "start", "quotas")


def _running(blocks: DataFrame) -> DataFrame:
    """Add the words of a source's blocks at smaller places, in two levels."""
    blocks = blocks.withColumn("part", F.floor(F.col("place") / PART_BLOCKS))
    parts = blocks.groupBy("idx", "part").agg(F.sum("words").alias("part_words"))
    over_parts = W.partitionBy("idx").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("idx", "part", F.coalesce(F.sum("part_words").over(over_parts), F.lit(0)).alias("part_before"))
    inside = W.partitionBy("idx", "part").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    return blocks.join(parts, ["idx", "part"]).withColumn(
        "before", F.col("part_before") + F.coalesce(F.sum("words").over(inside), F.lit(0))
    )


def _apart(rows: DataFrame) -> DataFrame:
    """Give rows alike in h different ones, by numbering them.

    n holds the rows' numbers as written, ascending inside each part. Copies are
    counted by part and numbered inside it, so that a hash which a large share of
    all rows has is never gathered.
    """
    alike = rows.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    if alike.isEmpty():
        return rows.drop("n")
    copies = rows.select("h", "n", F.shiftright("n", 33).alias("part")).join(alike, "h")
    before = F.sum("k").over(W.partitionBy("h").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    parts = copies.groupBy("h", "part").agg(F.count("*").alias("k")).select("h", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    inside = F.row_number().over(W.partitionBy("h", "part").orderBy("n")) - 1
    numbered = copies.withColumn("inside", inside).join(parts, ["h", "part"]).select("n", (F.col("ahead") + F.col("inside")).alias("copy"))
    told = rows.join(numbered.where("copy > 0"), "n", "left")
    return told.withColumn("h", F.when(F.col("copy").isNull(), F.col("h")).otherwise(F.xxhash64("h", "copy"))).drop("n", "copy")


def _settled(docs: DataFrame, doc_id: str, text: str, source: str, keep: list[str] | None) -> DataFrame:
    """The documents with their hash, source and words, written once: (row, source, h, words)."""
    found, _ = durable(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(source).alias("source"),
            _unit(F.col(doc_id), F.col(text), F.col(source)).alias("h"), words(F.col(text)).alias("words"),
            F.monotonically_increasing_id().alias("n"),
        ),
        "mix-rows", "zstd",
    )
    return _apart(found)


def plan(narrow: DataFrame, weights=WEIGHTS, most=MOST, seed=SEED):
    """Tables that place every document: sources, and the draws of each block.

    narrow: source, h, words; a row for each document.
    """
    sizes = narrow.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("rows"))
    counted = targets(sizes, weights, most).join(
        sizes.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))
    ).drop("s")
    whole = sizes.agg(F.sum("source_size"), F.sum("rows")).first()
    block_words = max(BLOCK_WORDS, (whole[0] or 0) // MOST_BLOCKS)
    block_rows = max(BLOCK_ROWS, (whole[1] or 0) // MOST_BLOCKS)
    blocks_by_words = F.ceil(F.col("source_size") / block_words)
    counted = counted.withColumn("n_blocks", F.greatest(blocks_by_words, F.ceil(F.col("rows") / block_rows), F.lit(1).cast("long")))
    some = F.col("source_size") > 0
    counted = counted.withColumn(
        "rounds", F.when(some, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most).cast("long"))).otherwise(0)
    ).withColumn("rest", F.when(some, F.col("target") - F.col("rounds") * F.col("source_size")).otherwise(0.0))
    order = W.orderBy(F.col("source").asc_nulls_last())
    sources, _ = durable(counted.withColumn("idx", F.row_number().over(order) - 1), "mix-sources")

    placed = in_blocks(narrow, sources)
    held = placed.groupBy("idx", "block").agg(F.sum("words").alias("words"))
    every = sources.select("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    sums, _ = durable(every.join(held, ["idx", "block"], "left").fillna(0, "words"), "mix-blocks")
    blocks = sums.join(sources.select("idx", "rest", "rounds", "n_blocks"), "idx")
    blocks = _running(blocks.withColumn("place", permuted("block", "n_blocks", F.col("rounds"))))
    whole = F.col("before") + F.col("words") <= F.col("rest")
    blocks, _ = durable(
        blocks.select(
            "idx", "block", "rounds", "n_blocks",
            (F.col("rest") - F.col("before")).alias("room"),
            (whole & (F.col("rest") > 0)).alias("extra"),
            (~whole & (F.col("before") < F.col("rest"))).alias("cut"),
        ),
        "mix-running",
    )
    # where the last block of the extra round is cut: the largest hash it takes
    cut_at = blocks.where("cut").select("idx", "block", "room")
    steps = placed.join(cut_at, ["idx", "block"]).groupBy("idx", "block", "room", "h").agg(F.sum("words").alias("words"))
    upto = F.sum("words").over(W.partitionBy("idx", "block").orderBy("h"))
    cuts = (
        steps.withColumn("upto", upto)
        .where(2 * F.col("upto") - F.col("words") <= 2 * F.col("room"))
        .groupBy("idx", "block").agg(F.max("h").alias("h_cut"))
    )
    blocks = blocks.join(cuts, ["idx", "block"], "left")
    partly = F.col("cut") & F.col("h_cut").isNotNull()
    rounds = F.when(F.col("rounds") > 0, F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1)).otherwise(
        F.array().cast("array<long>")
    )
    taken = F.concat(rounds, F.when(F.col("extra") | partly, F.array("rounds")).otherwise(F.array().cast("array<long>")))
    draws, _ = durable(
        blocks.select(
            "idx", "block", F.when(partly, F.col("rounds")).alias("cut_round"), "h_cut", "n_blocks", F.explode(taken).alias("round")
        ).withColumn("draw", F.col("round") * F.col("n_blocks") + permuted("block", "n_blocks", F.col("round"))),
        "mix-draws",
    )
    words_out = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, math.ceil(words_out / SHARD_WORDS))
    per_source = draws.groupBy("idx").agg(F.max("draw").alias("last"))
    quotas = (
        sources.select("idx").join(per_source, "idx", "left")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.col("last") + 1, F.lit(0).cast("long")).alias("q")))), lambda x: x["q"]).alias("quotas"))
    )
    leaves = split_tree(quotas, shards, seed)
    ranges = leaves.select("shard", F.posexplode(F.arrays_zip("start", "quotas")).alias("idx", "r")).where("r.quotas > 0")
    owned = ranges.select("shard", "idx", F.explode(F.sequence(F.col("r.start"), F.col("r.start") + F.col("r.quotas") - 1)).alias("draw"))
    homes, _ = durable(
        draws.join(owned, ["idx", "draw"])
        .groupBy("idx", "block")
        .agg(
            F.array_sort(F.collect_list(F.struct("round", "shard"))).alias("draws"),
            F.first("cut_round").alias("cut_round"), F.first("h_cut").alias("h_cut"),
        ),
        "mix-homes",
    )
    return sources, homes


def in_blocks(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add source index and block; rows have source and h."""
    keys = sources.select(F.col("source").alias("_s"), "idx", "n_blocks", "source_size", "target")
    return (
        rows.join(keys, F.col("source").eqNullSafe(F.col("_s")))
        .withColumn("block", F.pmod(F.col("h"), F.col("n_blocks")))
        .drop("_s", "n_blocks")
    )


def placements(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None, **options
) -> DataFrame:
    """Every document with its draws: (row, size, source_size, target, draws).

    row is a struct of the document's own columns, or of those in keep; draws is
    an array of (round, shard), empty where the mix leaves the document out.
    """
    rows = _settled(docs, doc_id, text, source, keep)
    sources, homes = plan(rows.select("source", "h", "words"), **options)
    found = in_blocks(rows, sources).join(homes, ["idx", "block"], "left")
    held = F.filter("draws", lambda d: F.col("cut_round").isNull() | (d["round"] < F.col("cut_round")) | (F.col("h") <= F.col("h_cut")))
    none = F.array().cast("array<struct<round:bigint,shard:bigint>>")
    return found.select("row", "h", F.col("words").alias("size"), "source_size", "target", F.coalesce(held, none).alias("draws"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: the documents' columns, a row for each draw, shuffled inside shards.

    Rows are partitioned by output shard and lie in random order there.
    """
    drawn = placements(docs, **options).select("row", "h", F.explode("draws").alias("d"))
    local = drawn.withColumn("place", F.xxhash64("h", "d.shard", "d.round", F.lit(SEED)))
    return local.repartition("d.shard").sortWithinPartitions("d.shard", "place").select("row.*")
