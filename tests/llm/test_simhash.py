"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from strandloom.llm import common, simhash
from strandloom.llm.common import durable
from strandloom.llm.simhash import fingerprint, near_duplicates, near_links


def plain(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def grouped(keys, linked):
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in keys:
        for b in keys:
            if linked(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: top(k) for k in keys}


def test_fingerprints(nasty_rows, sample):
    texts = [r[1] for r in nasty_rows] + [r["text"] for r in sample.select("text").limit(40).collect()]
    assert [fingerprint(t) for t in texts] == [plain(t) for t in texts]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {plain(r["text"]) for r in rows}
    groups = grouped(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2)
    first = {}
    for r in rows:
        g = groups[plain(r["text"])]
        if r["doc_id"] is not None:
            first[g] = min(first.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(((r["doc_id"], plain(r["text"]), first.get(groups[plain(r["text"])])) for r in rows), key=repr)
    got = near_duplicates(docs).select("doc_id", "fp", "component_id").collect()
    assert sorted(((r[0], r[1] % (1 << 64), r[2]) for r in got), key=repr) == want


def test_nasty_texts(nasty):
    check(nasty)


def test_test_tables(sample):
    check(sample)


def test_empty_table(no_docs):
    assert near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("limit", [1, 32, 10_000])
def test_links_join_the_same_groups_at_any_crowd(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "PAIR_LIMIT", limit)
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    words = set()
    for c in centres:
        for _ in range(60):
            word = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                word ^= 1 << int(b)
            words.add(word)
    words |= {0, 1, (1 << 64) - 1, (1 << 63)}
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = near_links(spark.createDataFrame([(w,) for w in signed], "fp long")).collect()
    edges = {(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in links}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges if limit > 1) or limit == 1
    keys = sorted(words)
    assert grouped(keys, lambda a, b: (a, b) in edges) == grouped(keys, lambda a, b: (a ^ b).bit_count() <= 2)


def test_clashing_columns(sample):
    docs = sample.limit(5).withColumn("fp", F.lit("x")).withColumn("root", F.lit("y"))
    assert near_duplicates(docs).count() == 5


def test_grid_is_never_broadcast_unmeasured(spark, monkeypatch):
    """The points exploded from a small file of fingerprints are many more than Spark takes them for."""
    plans = []

    def noted(df, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return durable(df, *rest)

    fps, _ = durable(spark.range(300).select((F.col("id") * 8191).bitwiseXOR(F.col("id") % 3).alias("fp")).distinct())
    want = grouped(keys := [r["fp"] for r in fps.collect()], lambda a, b: (a ^ b).bit_count() <= 2)
    monkeypatch.setattr(simhash, "durable", noted)
    for most in (32 << 20, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        found = near_links(fps)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        edges = {(r["a"], r["b"]) for r in found.collect()}
        assert grouped(keys, lambda a, b: (a, b) in edges) == want
        assert any("BroadcastHashJoin" in p for p in plans) == (most > 0) and "Join" in plans[-1]
        plans.clear()
