"""Embedding near-duplicates by a subspace pigeonhole join, exact at its threshold.

Unit vectors with cosine c lie at squared distance 2 - 2c. An orthogonal rotation
keeps distances and spreads what separates two vectors over all axes. Rotated
vectors are cut into blocks of BLOCK_DIM axes, and each block gets the share of
the squared-distance budget that its axes have: two vectors within the budget
are within the share of at least one block, so the union of the blocks' range
joins holds every pair. Candidates are verified with the cosine of the vectors
as given, in double precision.

The range joins run together. Vectors are laid out in chunks of bounded size by
recursive medians over all rotated axes, whose bounds come from a sample of
SAMPLE_ROWS; every vector is placed, and a leaf that holds more than a chunk is
cut by a hash. Two chunks are joined if their bounding boxes are within the budget,
and so within the share of some block, and are visited once. A visit first bounds
each pair by the squared distance on the leading axes alone, which is never above
that on all axes; what is left is tested on the blocks whose boxes are near, and
what any of them lets through is verified. No pair is tested in more than one
visit, and nothing has to be deduplicated.

Chunks meet in a nested loop over partitions of them: a chunk is written once,
whatever the number of chunks it meets, so disk grows with the vectors only. A
visit holds two chunks and one slice, and a dense group makes more visits, not
larger ones. It reports links as a count for each vector and a spanning star for
each group in it, never as a list of pairs.

Vectors that are alike are one class before the join; the copies only add to
the counts.

Defined results
    null or zero vector, null or non-finite components   no links; kept
    vectors of another length                            are not compared
    ties, repeated rows                                  rows with equal vectors are linked with each
                                                         other, each row counting as one vector
    repeated ids                                         each row has the links of its own vector
    null id                                              no links, null component, not kept
    empty table                                          empty result
    clashing columns                                     only the named columns are read
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm import vectors
from strandloom.llm.common import bounded_batches, discard, durable
from strandloom.llm.graph import components

THRESHOLD = 0.9
BLOCK_DIM = 16
#: Vectors of a chunk at most, on average where a leaf is cut by a hash.
CHUNK_ROWS = 4_096
#: Vectors that the bounds of the leaves are fitted on, at most.
SAMPLE_ROWS = 16_384
#: Chunks of either side whose boxes a task compares, at most and at least, and pairs that are tested at once.
BOX_ROWS, LEAST_BOX_ROWS = 64, 4
SLICE_PAIRS = 1 << 19
#: Tasks of the visits, unless that takes more than BOX_ROWS.
MOST_TASKS = 20_000
#: Share of the axes that bound a pair, and their least number.
LEAD_SHARE, LEAD_LEAST = 3 / 8, 8
SEED = 8
#: Slack for the rounding of the filters in single precision, far above its error.
COARSE = 1e-4


def rotation(width: int) -> np.ndarray:
    """A random orthogonal matrix, the same for everyone."""
    q, r = np.linalg.qr(np.random.RandomState(SEED).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def _blocks(width: int) -> list[tuple[int, int]]:
    return [(a, min(a + BLOCK_DIM, width)) for a in range(0, width, BLOCK_DIM)]


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares can't overflow
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _budgets(width: int, threshold: float) -> np.ndarray:
    total = 2 - 2 * threshold
    return np.array([total * (b - a) / width for a, b in _blocks(width)])


class Layout:
    """Leaves of recursive medians over the rotated axes of vectors of one length."""

    def __init__(self, sample: np.ndarray, leaf_rows: int):
        self.turn = rotation(sample.shape[1])
        self.axis: list[int] = []
        self.at: list[float] = []
        self.sides: list[tuple[int, int]] = []
        self._grow(_unit(sample) @ self.turn, leaf_rows)

    def _grow(self, rows: np.ndarray, leaf_rows: int) -> int:
        """Number of the node over rows; leaves have axis -1."""
        node = len(self.axis)
        self.axis.append(-1)
        self.at.append(0.0)
        self.sides.append((-1, -1))
        if len(rows) > leaf_rows:
            axis = int(rows.var(axis=0).argmax())
            at = float(np.median(rows[:, axis]))
            left = rows[:, axis] < at
            if left.any() and not left.all():
                self.axis[node], self.at[node] = axis, at
                self.sides[node] = (self._grow(rows[left], leaf_rows), self._grow(rows[~left], leaf_rows))
        return node

    def leaves(self, turned: np.ndarray) -> np.ndarray:
        """Leaf of each rotated vector."""
        out = np.zeros(len(turned), dtype=np.int64)
        stack = [(0, np.arange(len(turned)))]
        while stack:
            node, rows = stack.pop()
            if self.axis[node] < 0:
                out[rows] = node
            elif len(rows):
                left = turned[rows, self.axis[node]] < self.at[node]
                stack += [(self.sides[node][0], rows[left]), (self.sides[node][1], rows[~left])]
        return out


def near_boxes(low_a, high_a, low_b, high_b, threshold: float) -> np.ndarray:
    """Blocks in which each pair of boxes is within the share, as bits; boxes are rows of bounds."""
    width = low_a.shape[1]
    out = np.zeros((len(low_a), len(low_b)), dtype=np.int64)
    for i in range(len(low_a)):
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b))
        for k, ((a, b), budget) in enumerate(zip(_blocks(width), _budgets(width, threshold), strict=True)):
            out[i] |= ((gap[:, a:b] ** 2).sum(axis=1) <= budget + COARSE).astype(np.int64) << k
    return out


def _star(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position of each position's group, for links a-b among n."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _lead(turned: np.ndarray) -> np.ndarray:
    """Leading axes of rotated vectors."""
    return turned[:, : max(LEAD_LEAST, math.ceil(LEAD_SHARE * turned.shape[1]))].astype("<f4")


def _filters(part: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors of a test for either side: their product is squared distance less budget."""
    norm, one = (part * part).sum(axis=1, keepdims=True), np.ones((len(part), 1), dtype=np.float32)
    return np.hstack([-2 * part, norm - np.float32(budget + COARSE), one]), np.hstack([part, one, norm])


@dataclass
class Chunk:
    """Vectors of a chunk: ids, sizes of their classes, the vectors as given, and their leading rotated axes."""

    ids: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray
    lead: np.ndarray


def _near(a: Chunk, b: Chunk, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that the leading axes don't rule out, in slices."""
    x, y = _filters(a.lead, 2 - 2 * threshold)[0], _filters(b.lead, 2 - 2 * threshold)[1].T
    step = max(1, SLICE_PAIRS // max(1, len(b.rows)))
    for start in range(0, len(a.rows), step):
        first = start + 1 if same else 0  # a chunk meets itself above the diagonal
        if first < len(b.rows):
            i, j = np.divmod(np.flatnonzero(x[start : start + step] @ y[:, first:] <= 0), len(b.rows) - first)
            i, j = i + start, j + first
            if same:
                i, j = i[j > i], j[j > i]
            for cut in range(0, len(i), 1 << 16):
                yield i[cut : cut + (1 << 16)], j[cut : cut + (1 << 16)]


def visit(a: Chunk, b: Chunk, blocks: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between two chunks: ids, links of each, and the smallest linked id of its group here.

    blocks: bits of the blocks to test. same: both chunks are one.
    """
    width = a.rows.shape[1]
    turn, budgets = rotation(width), _budgets(width, threshold)
    tests = [(x, y, budgets[k]) for k, (x, y) in enumerate(_blocks(width)) if blocks >> k & 1]
    found_a, found_b = [], []
    for p, q in _near(a, b, threshold, same):
        apart = ((_unit(a.rows[p].astype(np.float64)) - _unit(b.rows[q].astype(np.float64))) @ turn) ** 2
        within = np.zeros(len(p), dtype=bool)
        for x, y, budget in tests:
            within |= apart[:, x:y].sum(axis=1) <= budget + COARSE
        p, q = p[within], q[within]
        linked = _cosine(a.rows[p], b.rows[q]) >= threshold
        found_a.append(p[linked])
        found_b.append(q[linked])
    p = np.concatenate(found_a) if found_a else np.empty(0, dtype=np.int64)
    q = np.concatenate(found_b) if found_b else np.empty(0, dtype=np.int64)
    if not len(p):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    ids, sizes = (a.ids, a.sizes) if same else (np.concatenate([a.ids, b.ids]), np.concatenate([a.sizes, b.sizes]))
    if not same:
        q = q + len(a.ids)
    links = np.bincount(p, weights=sizes[q], minlength=len(ids)) + np.bincount(q, weights=sizes[p], minlength=len(ids))
    order = np.argsort(ids, kind="stable")  # so that the smallest position is the smallest id
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.arange(len(ids))
    root = ids[order][_star(rank[p], rank[q], len(ids))][rank]
    has = links > 0
    return ids[has], links[has].astype(np.int64), root[has]


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


def layouts(classes: DataFrame) -> dict[int, Layout]:
    """Leaves for the vectors of each length, from a sample by the hash of the id."""
    sizes = {r["dim"]: r["n"] for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).collect()}
    sample = classes.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(SAMPLE_ROWS).select("v").collect()
    by_dim: dict[int, list] = {dim: [] for dim in sizes}
    for r in sample:
        by_dim[len(r["v"])].append(r["v"])
    share = max(1, len(sample)) / max(1, sum(sizes.values()))
    # leaves half as large as a chunk in the mean, so that few are above it
    return {dim: Layout(np.array(rows or [[1.0] * dim]), max(1, int(share * CHUNK_ROWS * 3 / 4))) for dim, rows in by_dim.items()}


def chunks(classes: DataFrame) -> DataFrame:
    """Chunks of classes (id, size, v): dim, packed ids, sizes, vectors and leading axes, and the bounds of their box."""
    by_dim = layouts(classes)
    kind = "<f4" if dict(classes.dtypes)["v"] == "array<float>" else "<f8"

    def place(batches):
        for batch in batches:
            dims = batch["v"].map(len).to_numpy()
            leaf = np.zeros(len(batch), dtype=np.int64)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                vectors_ = np.array(batch["v"].iloc[rows].tolist(), dtype=np.float64)
                leaf[rows] = by_dim[dim].leaves(_unit(vectors_) @ by_dim[dim].turn)
            yield batch.assign(dim=dims, leaf=leaf)

    placed = classes.select("id", "size", "v").mapInPandas(place, f"id long, size long, v {dict(classes.dtypes)['v']}, dim int, leaf long")
    placed, path = durable(placed, "neighbour-leaves")
    cut = placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("cuts"))
    members = placed.join(cut, ["dim", "leaf"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts")))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        dim = int(group["dim"].iloc[0])
        rows = np.array(group["v"].tolist(), dtype=kind)
        turned = _unit(rows.astype(np.float64)) @ by_dim[dim].turn
        out = {"dim": dim, "ids": group["id"].to_numpy("<i8").tobytes(), "sizes": group["size"].to_numpy("<i8").tobytes()}
        out |= {"v": rows.tobytes(), "lead": _lead(turned).tobytes(), "low": turned.min(axis=0).tolist(), "high": turned.max(axis=0).tolist()}
        return pd.DataFrame([out])

    shape = "dim int, ids binary, sizes binary, v binary, lead binary, low array<double>, high array<double>"
    packed = members.groupBy("dim", "leaf", "cut").applyInPandas(gather, shape)
    found, _ = durable(packed.withColumn("chunk", F.monotonically_increasing_id()), "neighbour-chunks")
    discard(classes.sparkSession, path)
    return found


def _once(a: Column, b: Column) -> Column:
    """Whether two chunks are visited in this order; each pair is in one, and either order has half of a chunk's pairs."""
    return F.when(F.xxhash64(F.least(a, b), F.greatest(a, b)) % 2 == 0, a <= b).otherwise(a >= b)


def visits(found: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of chunks to visit: all columns of two chunks, a_ and b_, whose boxes are within the budget."""
    count = found.count()
    held = max(1, min(BOX_ROWS, max(LEAST_BOX_ROWS, math.ceil(count / math.isqrt(MOST_TASKS)))))
    dealt = found.repartition(max(1, math.ceil(count / held)))
    a, b = (dealt.select([F.col(c).alias(f"{side}_{c}") for c in found.columns]) for side in "ab")
    gap = F.zip_with(
        F.zip_with("a_low", "b_high", lambda x, y: x - y), F.zip_with("b_low", "a_high", lambda x, y: x - y),
        lambda x, y: F.greatest(x, y, F.lit(0.0)),
    )
    apart = F.aggregate(gap, F.lit(0.0), lambda total, x: total + x * x)
    # lengths are no key to join by: nearly all vectors have the same
    alike = F.abs(F.col("a_dim") - F.col("b_dim")) < 1
    near = alike & _once(F.col("a_chunk"), F.col("b_chunk")) & (apart <= 2 - 2 * threshold + COARSE)
    return a.hint("shuffle_replicate_nl").join(b.hint("shuffle_replicate_nl"), near)


def links(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Partial links of classes (id, size, v): (id, n, root), to be summed by id."""
    kind = "<f4" if dict(classes.dtypes)["v"] == "array<float>" else "<f8"

    def joined(batches):
        for batch in batches:
            for r in batch.itertuples():
                packed = ((r.a_ids, r.a_sizes, r.a_v, r.a_lead), (r.b_ids, r.b_sizes, r.b_v, r.b_lead))
                a, b = (
                    Chunk(
                        vectors.ids(ids), vectors.ids(sizes), np.frombuffer(v, dtype=kind).reshape(-1, r.a_dim),
                        np.frombuffer(lead, dtype="<f4").reshape(len(vectors.ids(ids)), -1),
                    )
                    for ids, sizes, v, lead in packed
                )
                low_a, high_a, low_b, high_b = (np.array([x]) for x in (r.a_low, r.a_high, r.b_low, r.b_high))
                blocks = int(near_boxes(low_a, high_a, low_b, high_b, threshold)[0, 0])
                out = visit(a, b, blocks, threshold, r.a_chunk == r.b_chunk)
                yield pd.DataFrame(dict(zip(("id", "n", "root"), out, strict=True)))

    return visits(chunks(classes), threshold).mapInPandas(joined, "id long, n long, root long")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept."""
    same = dict(rows.dtypes)[vector] == "array<float>"  # exact in double precision, and half as long
    doubles = F.col(vector) if same else F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & vectors.finite(F.col("v")) & F.exists("v", lambda x: x != 0)
    rows = bounded_batches(rows).select(F.col(vec_id).cast("long").alias("vec_id"), doubles.alias("v"))
    # rows find their class by two hashes of 64 bits, so that vectors are shuffled once, for the classes
    digests = [F.when(usable, F.xxhash64(F.lit(k), "v")).alias(f"digest_{k}") for k in (0, 1)]
    rows, _ = durable(rows.select("vec_id", F.when(usable, F.col("v")).alias("v"), *digests), "neighbour-rows")
    key = ["digest_0", "digest_1"]
    classes = rows.where("v is not null").groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
    # numbered as they are written: different vectors may share an id
    classes, _ = durable(classes.withColumn("id", F.monotonically_increasing_id()), "neighbour-classes")
    partial, _ = durable(links(classes, threshold), "neighbour-links")
    sums = partial.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(partial.where("id <> root").select("id", "root"), "id", "root")
    grouped = classes.join(sums, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = grouped.join(smallest, "root").select(*key, (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    alone = F.when(F.col("digest_0").isNull(), F.col("vec_id"))
    found = rows.drop("v").join(labelled, key, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", alone).alias("component_id")
    )
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
