"""The mix against its definition, and the splitting tree's exactness."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing
from strandloom.llm.mixing import mix, placements, split_tree, targets


def filled(sizes):
    """Target of each source by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        left = sum(weight[s] for s in order if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else rest * weight[s] / left for s in order}
        above = {s for s in order if s not in capped and share[s] > 3 * sizes[s]}
        if not above:
            return share
        capped |= above


def check(docs, near=None):
    rows = placements(docs).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in texts:
        sizes[r["source"]] += size(r["text"])
    want = filled(sizes)
    taken, largest = Counter(), Counter()
    assert len(rows) == len(texts)
    for r in rows:
        row = r["row"]
        assert r["size"] == size(row["text"]) and r["source_size"] == sizes[row["source"]]
        assert r["target"] == pytest.approx(want[row["source"]])
        assert len(r["draws"]) <= 3 and len({d["round"] for d in r["draws"]}) == len(r["draws"])
        taken[row["source"]] += r["size"] * len(r["draws"])
        largest[row["source"]] = max(largest[row["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    return rows


def test_test_tables(sample, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 5_000)
    monkeypatch.setattr(mixing, "PART_BLOCKS", 3)
    rows = check(sample)
    again = check(sample.repartition(3))
    key = lambda rs: sorted((r["row"]["doc_id"], [tuple(d) for d in r["draws"]]) for r in rs)
    assert key(rows) == key(again)
    assert len({d["shard"] for r in rows for d in r["draws"]}) > 5


def test_nasty_texts(nasty):
    check(nasty)


@pytest.mark.parametrize(
    ("ids", "text"),
    [
        ("null", "concat('text ', id, repeat(' word', cast(id % 9 as int)))"),
        ("id % 3", "repeat('word ', cast(id % 4 as int))"),
        ("if(id % 2 = 0, null, 7)", "'five words in this text'"),
    ],
)
def test_null_and_repeated_ids(spark, ids, text, monkeypatch):
    """Targets are met however rows repeat, also where most of them are one row."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 200)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1_000)
    docs = spark.range(0, 900, 1, 5).selectExpr(
        f"cast({ids} as long) AS doc_id", f"{text} AS text", "case when id % 3 > 0 then 'a' when id % 2 = 0 then 'b' end AS source"
    )
    check(docs)


def test_rounds_are_permutations(spark):
    sizes = spark.createDataFrame([(n,) for n in (1, 2, 7, 64, 1000)], "n long").selectExpr("n", "explode(sequence(0L, n - 1)) AS block")
    for r in range(5):
        places = sizes.select("n", "block", mixing.permuted("block", "n", F.lit(r)).alias("p")).collect()
        for n in (1, 2, 7, 64, 1000):
            assert sorted(x["p"] for x in places if x["n"] == n) == list(range(n))
    assert [x["p"] for x in places if x["n"] == 1000] != list(range(1000))


def test_capped_sources(spark):
    sizes = {"a": 1000, "b": 1, "c": 2, None: 5, "d": 0}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in targets(df).collect()}
    want = filled(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes)


def test_empty_and_blank_tables(spark, no_docs):
    assert placements(no_docs).count() == 0 and mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert mix(blank).count() == 0
    assert [r["target"] for r in placements(blank).collect()] == [0.0, 0.0]


def test_mix_rows_are_the_draws(sample):
    drawn = Counter()
    for r in placements(sample).collect():
        drawn[r["row"]["doc_id"]] += len(r["draws"])
    assert Counter(r["doc_id"] for r in mix(sample).collect()) == +drawn
    assert mix(sample.withColumn("idx", F.lit(1)).withColumn("block", F.lit(2))).columns[-2:] == ["idx", "block"]


def test_tree_splits_quotas_exactly(spark):
    quotas = [7, 0, 1_000, 13, 250]
    leaves = split_tree(spark.createDataFrame([(quotas,)], "quotas array<long>"), 11).orderBy("shard").collect()
    held = np.array([r["quotas"] for r in leaves])
    assert held.sum(axis=0).tolist() == quotas and len(leaves) == 11
    assert (held.sum(axis=1) >= sum(quotas) // 11 - 4).all() and (held.sum(axis=1) <= sum(quotas) // 11 + 5).all()
    starts = np.array([r["start"] for r in leaves])
    assert (starts == np.cumsum(held, axis=0) - held).all()
