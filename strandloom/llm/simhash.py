"""SimHash fingerprints and their exact near-duplicate join.

A 64-bit fingerprint is mapped to the bit counts of its sixteen 4-bit segments.
Each differing bit moves one count by one, so the Manhattan distance of two
count vectors is a lower bound of the fingerprints' Hamming distance, and a
range join on the count grid loses no pair. Radius two is joined by meeting
half way: a fingerprint goes to its own grid point and to the points one step
away, and two vectors at distance two or less share such a point. Pairs that
meet are then verified on the fingerprints.

A grid point that many fingerprints share is not paired up but gridded again
with the finest segments, of one bit: there a count is a bit, a step is a flip,
and the lower bound is the distance itself. Two fingerprints that meet on this
grid need no check, so a star from the smallest one of a point links the same
groups with as many rows as there are steps, whatever the size of the group.
Of random fingerprints, two share a point of the coarse grid with probability
1e-9, so points hold PAIR_LIMIT of them from about a billion different
fingerprints on; below, only groups of near copies are gridded twice.

Defined results
    null or blank text  fingerprint zero, linked like any other
    very long text      every shingle counts; held whole, hashed in blocks
    under three words   the whole word sequence is the one shingle
    ties, repeated rows equal fingerprints are one class before anything is joined
    null doc_id         linked like others; a group's id is its smallest known id
    empty table         empty result
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, durable, spread_join
from strandloom.llm.graph import components

SHINGLE_WORDS = 3
SEED = 42
SEGMENTS = 16
SEGMENT_BITS = 4
#: Above this many fingerprints at one grid point, the finest grid replaces pairs there.
PAIR_LIMIT = 32
#: Bytes of a row of a few longs in a broadcast table, with its share of the hash table.
ROW_BYTES = 100
#: Fingerprints that one task maps to grid points, 33 each.
GRID_ROWS, MOST_TASKS = 50_000, 20_000


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """SimHash of one text over its word shingles, repeats included.

    bytes.lower() changes A-Z only and bytes.split() cuts at the six ASCII
    white-space characters, as the word definition asks.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, seed = xxhash.xxh64_intdigest, SEED
    view = memoryview(line)
    hashes = [digest(view[a:b], seed) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for block in range(0, len(packed), 1 << 16):
        ones += np.unpackbits(packed[block : block + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """Fingerprint as a signed 64-bit integer with the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))

    return run(text.cast("string"))


def _grid_points(fp: Column) -> Column:
    """Own grid point and all points one count away, as packed 4-bit counts."""
    counts = [F.bit_count(fp.bitwiseAND(F.lit(0xF << (4 * s) if s < 15 else -(1 << 60)))) for s in range(SEGMENTS)]
    own = F.lit(0).cast("long")
    for s, c in enumerate(counts):
        own = own.bitwiseOR(F.shiftleft(c.cast("long"), 4 * s))
    steps = [own]
    for s, c in enumerate(counts):
        steps.append(F.when(c < SEGMENT_BITS, own.bitwiseXOR(_changed(c, s, 1))))
        steps.append(F.when(c > 0, own.bitwiseXOR(_changed(c, s, -1))))
    return F.array_compact(F.array(*steps))


def _changed(count: Column, segment: int, by: int) -> Column:
    """Bits of the packed vector that change when a count moves by one."""
    return F.shiftleft(count.bitwiseXOR(count + by).cast("long"), 4 * segment)


def _flips(fp: Column) -> Column:
    """The fingerprint and its 64 one-bit flips."""
    bits = F.sequence(F.lit(0), F.lit(63))
    one = F.lit(1).cast("long")
    return F.concat(F.array(fp), F.transform(bits, lambda i: fp.bitwiseXOR(F.call_function("shiftleft", one, i))))


def near_links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, that join the same groups as all pairs within two bits.

    fps: distinct fingerprints in a column fp. Spark sizes the exploded points as if
    they were no more than the fingerprints, so no join with them is left to its
    size check: sizes are broadcast by their measured number, the rest is merged.
    """
    tasks = min(MOST_TASKS, 1 + fps.count() // GRID_ROWS)
    met = fps.repartition(tasks, "fp").select("fp", F.explode(_grid_points(F.col("fp"))).alias("point"))
    sizes, _ = durable(met.groupBy("point").agg(F.count("*").alias("n")).where("n > 1"), "simhash-points")
    placed, _ = durable(spread_join(met, sizes, "point", ROW_BYTES, "inner", sizes), "simhash-grid")
    small = placed.where(F.col("n") <= PAIR_LIMIT)
    left = small.select("point", F.col("fp").alias("a"))
    right = small.select("point", F.col("fp").alias("b"))
    pairs = (
        left.join(right.hint("merge"), "point")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    crowded = placed.where(F.col("n") > PAIR_LIMIT).select("fp").distinct()
    words = crowded.select("fp", F.explode(_flips(F.col("fp"))).alias("word"))
    hubs = words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1").select("word", "a")
    stars = words.join(hubs.hint("merge"), "word").where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """Group of every distinct fingerprint: fp, root (the smallest fingerprint of the group), component_id.

    prints: doc_id, fp; a row for each document.
    """
    classes, _ = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    linked = components(near_links(classes.select("fp")), "a", "b")
    labelled = classes.join(linked.select(F.col("node").alias("fp"), "root").hint("merge"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return labelled.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, fp (long), root (its group's smallest fingerprint), component_id."""
    prints, _ = durable(
        bounded_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text)).alias("fp")), "simhash-prints"
    )
    found, _ = durable(groups(prints), "simhash-groups")
    return spread_join(prints, found, "fp", ROW_BYTES, "inner").select("doc_id", "fp", "root", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with docs' columns: the row with the smallest id.

    Among rows that share it, or where a group has no ids, the row with the
    smallest hash. Rows are numbered once and for all by writing them, so each
    group keeps exactly one, whatever ids are null or repeated, and no group is
    gathered: its first row is a map-side aggregation.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows, _ = durable(
        bounded_batches(docs).select(
            F.struct(*own).alias("row"), F.col(doc_id).alias("id"), fingerprint_column(F.col(text)).alias("fp"),
            F.xxhash64(*own).alias("h"), F.monotonically_increasing_id().alias("n"),
        ),
        "simhash-rows", "zstd",
    )
    first = lambda c: F.min(c).alias("first")
    heads = rows.groupBy("fp").agg(first(F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "n")))
    of_group = heads.join(groups(rows.select(F.col("id").alias("doc_id"), "fp")), "fp").groupBy("root").agg(first("first"))
    kept = of_group.select(F.col("first.n").alias("n"))
    return rows.select("row", "n").join(kept, "n").select("row.*")
