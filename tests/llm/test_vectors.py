"""Top-k search and near-duplicate links against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import neighbours, topk, vectors
from strandloom.llm.neighbours import near_duplicates
from strandloom.llm.topk import quantised, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows_of(n=240, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    out = []
    for i in range(n):
        v = centres[i % 12] + rng.standard_normal(dim) * (0.05 + 0.4 * (i % 5))
        out.append((i, [float(x) for x in np.float32(v / np.linalg.norm(v))], i % 3))
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [math.nan] + [1.0] * (dim - 1), [math.inf] * dim, out[0][1], out[0][1], [1.0, 2.0], [2.0, 4.0]]
    out += [(1000 + 50 * i, v, 0) for i, v in enumerate(odd)]
    return [*out, (7, out[7][1], 0), (7, out[7][1], 0), (None, out[5][1], 0)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(rows, k=5):
    q = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    out = []
    for n, (a, v) in enumerate(q):
        if a % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), b) for m, (b, w) in enumerate(q) if m != n and len(w) == len(v))
            out += [(a, rank + 1, b, -s) for rank, (s, b) in enumerate(scores[:k])]
    return sorted(out)


#: Rows that share an id with a query: alike, of another vector, and many copies.
SHARED = [(0, 0), (0, 5), (50, 50), (50, 50), (50, 50), (50, 51), (100, 7), (150, 150)] + [(9, 50)] * 7


@pytest.mark.parametrize(("shard", "block", "fan", "scores"), [(8192, 1024, 32, 1 << 22), (16, 3, 2, 40)])
def test_search(spark, monkeypatch, shard, block, fan, scores):
    """Query rows that share an id are asked on their own, and may find each other."""
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "FAN_IN", fan)
    monkeypatch.setattr(topk, "SLICE_SCORES", scores)
    rows = rows_of()
    rows += [(i, rows[j][1], 0) for i, j in SHARED]
    base = spark.createDataFrame(rows, SCHEMA).where(vectors.finite(F.col("embedding")))
    base = base.select("vec_id", quantised(F.col("embedding")).alias("q"), F.lit(1).alias("copies"), F.lit(2).alias("id"))
    got = search(base, base.where("vec_id % 50 = 0"), 5)
    assert dict(got.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.collect())) == brute_top(rows)


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, q array<long>")
    assert search(empty, empty, 5).count() == 0


def test_large_components_stay_exact():
    a, b = np.array([[3 << 30, 1]]), np.array([[1 << 30, 7]])
    assert topk._product(a, b)[0, 0] == (3 << 60) + 7
    with pytest.raises(OverflowError):
        topk._product(np.array([[1 << 40]]), np.array([[1 << 40]]))


def brute_links(rows, least=0.9):
    n = len(rows)
    ok = [i is not None and usable(v) and any(v) for i, v, _ in rows]
    root, count = list(range(n)), [0] * n

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if ok[a] and ok[b] and len(x) == len(y):
                x, y = np.array(x, dtype=float), np.array(y, dtype=float)
                if (x == y).all() or x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    count[a] += 1
                    count[b] += 1
                    root[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for k in range(n):
        if rows[k][0] is not None:
            low[top(k)] = min(low.get(top(k), rows[k][0]), rows[k][0])
    out = []
    for k in range(n):
        mine = low.get(top(k)) if rows[k][0] is not None else None
        out.append((rows[k][0], count[k], mine, mine is not None and rows[k][0] == mine))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("chunk", "dim", "boxes"), [(4096, 16, 2048), (30, 5, 3)])
def test_links(spark, monkeypatch, chunk, dim, boxes):
    """Also of vectors that share an id, on one or many chunks."""
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(neighbours, "BLOCK_DIM", dim)
    monkeypatch.setattr(neighbours, "BOX_ROWS", boxes)
    rows = rows_of()
    rows += [(i, rows[j][1], 0) for i, j in SHARED]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("v", F.lit(2)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_links(rows)


def test_boxes_lose_no_pair():
    """Two vectors within the budget lie in boxes that are near in some block."""
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((400, 24))
    rows = neighbours._unit(np.vstack([rows, rows + 0.05 * rng.standard_normal(rows.shape)])) @ neighbours.rotation(24)
    leaf = neighbours.Layout(rows @ neighbours.rotation(24).T, 20).leaves(rows)
    names = np.unique(leaf)
    low, high = (np.array([f(rows[leaf == x], axis=0) for x in names]) for f in (np.min, np.max))
    near = neighbours.near_boxes(low, high, low, high, 0.9) > 0
    i, j = np.nonzero(rows @ rows.T >= 0.9)
    at = np.searchsorted(names, leaf)
    assert len(names) > 30 and near[at[i], at[j]].all()
    assert not (neighbours.near_boxes(low, high, low, high, 0.999) > 0).all()


def test_links_of_nothing(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def records_shuffled(plan):
    """Records that each exchange of a plan has written, once it has run."""
    name = plan.getClass().getSimpleName()
    if name == "ReusedExchangeExec":
        return []
    if name == "AdaptiveSparkPlanExec" or name.endswith("QueryStageExec"):
        return records_shuffled(plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan())
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if name == "ShuffleExchangeExec" else []
    return own + [n for i in range(plan.children().size()) for n in records_shuffled(plan.children().apply(i))]


def test_chunks_are_shuffled_once_however_many_they_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_ROWS", 30)
    rng = np.random.default_rng(4)
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 16)))]
    classes = spark.createDataFrame(rows, "id long, size long, v array<double>")
    count = neighbours.chunks(classes).count()
    found = neighbours.links(classes)
    found.collect()
    assert count > 12 and 0 < sum(records_shuffled(found._jdf.queryExecution().executedPlan())) <= 2 * count
