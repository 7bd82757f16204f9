"""The lookup table against a direct reading of its rule."""

from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm.queries.op07 import SHARDS, op7_sharding
from strandloom.llm.sharding import TABLE_SIZE, _number, lookup_table, place


def brute(shards, size):
    lists = {}
    for s in shards:
        offset, step = _number(s, "offset") % size, _number(s, "step") % (size - 1) + 1
        lists[s] = [(offset + k * step) % size for k in range(size)]
    table = {}
    while len(table) < size:
        for s in sorted(shards):
            if len(table) < size:
                table[next(x for x in lists[s] if x not in table)] = s
    return [table[i] for i in range(size)]


@pytest.mark.parametrize("shards", [["a"], ["b", "a", "c"], [f"n{i}" for i in range(13)]])
def test_table(shards):
    for size in (13, 101):
        assert [shards[i] for i in lookup_table(shards, size)] == brute(shards, size)


def test_table_is_even_and_steady():
    many = lookup_table(SHARDS)
    shares = Counter(many)
    assert max(shares.values()) - min(shares.values()) <= 1
    fewer = lookup_table(SHARDS[:-1])
    moved = sum(a != b for a, b in zip(many, fewer, strict=True) if a != len(SHARDS) - 1)
    assert moved < 0.05 * TABLE_SIZE


@pytest.mark.parametrize(("shards", "size"), [([], 13), (["a", "a"], 13), (["a"], 12), ([str(i) for i in range(20)], 13)])
def test_bad_tables(shards, size):
    with pytest.raises(ValueError):
        lookup_table(shards, size)


def test_placement(spark, nasty, no_docs):
    rows = place(nasty.withColumn("slot", F.lit("old")), "doc_id", SHARDS).collect()
    table = lookup_table(SHARDS)
    for r in rows:
        if r["doc_id"] is None:
            assert r["slot"] is None and r["shard"] is None
        else:
            assert r["slot"] == xxhash.xxh64_intdigest(str(r["doc_id"]), 42).__xor__(1 << 63).__sub__(1 << 63) % TABLE_SIZE
            assert r["shard"] == SHARDS[table[r["slot"]]]
    assert place(no_docs, "doc_id", SHARDS).count() == 0
    assert op7_sharding(spark, "/root/testdata/sf0.001").count() == 200


def test_plan_is_native(spark):
    plan = op7_sharding(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
