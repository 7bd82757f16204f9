"""Each stage of the pipeline on its own input, and the whole run."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from brute import accepted_spans, languages
from strandloom.llm import common, pii
from strandloom.llm.common import durable
from strandloom.llm.simhash import fingerprint
from test_mixing import filled

SF = "/root/testdata/sf0.001"
KEY = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output on the smallest tables plus odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 10_000)
    odd = spark.createDataFrame(
        [(20_000, None, "en", "a", 0), (20_001, "", None, None, 0), (20_002, "12 34", "en", "a", 5), (None, "the lost and found of the thing", "en", "a", 31), (None, "the lost and found of the thing", "en", "b", 31)],
        docs.schema,
    )
    docs = durable(docs.union(first.select(docs.columns)).union(odd), "t")[0]
    out = {}
    for name, stage in cp.STAGES:
        found = durable(stage(spark, docs, SF), "t")[0]
        out[name] = (docs, found)
        docs = found
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "personal_data", "mixture", "tokens"]
    assert all(stages[n][1].columns == cp.COLUMNS for n in ("language", "near_copies", "personal_data", "mixture"))


def test_language(stages):
    before, after = (x.collect() for x in stages["language"])
    found = languages([(r["text"], r["lang"], r["source"], None, None) for r in before])
    want = [(r["doc_id"], r["text"], lang, r["source"], r["n_chars"]) for r, (lang, _, rejected) in zip(before, found, strict=True) if not rejected]
    assert Counter(map(tuple, after)) == Counter(want)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {20_000, 20_001, 20_002} <= gone and len(gone) <= 6


def test_near_copies(stages):
    before, after = (x.collect() for x in stages["near_copies"])
    prints = {r["text"]: fingerprint(r["text"]) for r in before}
    root = {p: p for p in prints.values()}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2 and top(a) != top(b):
                root[top(a)] = top(b)
    groups = {}
    for r in before:
        groups.setdefault(top(prints[r["text"]]), []).append(r)
    want = []
    for rows in groups.values():
        named = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        want.append(min(named) if named else None)
    assert Counter(r["doc_id"] for r in after) == Counter(want)
    assert len(after) < len(before)


def test_personal_data(stages):
    before, after = stages["personal_data"]
    rows = before.select("doc_id", "text", pii.candidates("text").alias("c")).collect()
    want = []
    for r, spans in zip(rows, accepted_spans([r["c"] for r in rows])[0], strict=True):
        text, at, out = r["text"], 0, ""
        for s in spans:
            if s["s"] >= at:
                out += text[at : s["s"]] + f"[{s['kind'].upper()}]"
            at = max(at, s["e"])
        want.append((r["doc_id"], out + text[at:] if spans else text))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=repr)
    assert not any(re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r["text"]) for r in after.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in after.where("text LIKE '%[EMAIL]%'").collect())


def test_mixture(stages):
    """Words of each source near its target, no document more than three times, nothing but documents."""
    before, after = (x.collect() for x in stages["mixture"])
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in before:
        sizes[r["source"]] += size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    for r in after:
        taken[r["source"]] += size(r)
    want = filled(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    stored, drawn = (Counter(map(tuple, x)) for x in (before, after))
    assert set(drawn) <= set(stored) and all(n <= 3 * stored[k] for k, n in drawn.items())


def test_tokens(stages):
    before, after = stages["tokens"]
    hashes = Counter(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in before.collect())
    assert Counter(r["decoded_sha256"] for r in after.collect()) == hashes
    assert np.all([r["n_tokens"] >= 0 for r in after.collect()])


def test_rows_that_share_an_id(spark):
    """Two texts under one id: both stay if they are no copies, whatever is a copy of which."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    rows = [(3, one), (5, one), (5, two), (7, three), (7, three), (9, two), (None, three), (8, "lone words of the one"), (8, one + " x"), (None, None), (1, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumn("fp", F.lit(0)).withColumn("row", F.lit(1))
    kept = [(r["doc_id"], r["text"]) for r in cp.near_copies(spark, docs, SF).collect()]
    groups = {}
    for i, t in rows:
        p = fingerprint(t)
        key = next((k for k in groups if (k ^ p).bit_count() <= 2), p)
        groups.setdefault(key, []).append((i, t))
    want = [min((x for x in g), key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert Counter(kept) == Counter(want) and (5, two) in kept and (3, one) in kept


def test_stages_on_empty_tables(spark, no_docs):
    for name, stage in cp.STAGES:
        out = stage(spark, no_docs.withColumn("extra", F.lit(1)).withColumn("row", F.lit(1)), SF)
        assert out.count() == 0 and (name == "tokens" or out.columns == cp.COLUMNS)


def test_stages_tidy_up(spark, sample):
    docs = durable(sample.limit(30), "t")[0]
    made = set(common._MADE)
    found = durable(cp.language(spark, docs, SF), "t")
    left = set(common._MADE) - made - {found[1]}
    assert left
    durable(cp.near_copies(spark, found[0], SF), "t")
    assert not left & set(common._MADE) and found[0].count() > 0


def test_whole_run(spark):
    assert cp.run(spark, SF).count() > 100 and cp.ORACLE_SQL is None
