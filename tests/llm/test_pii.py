"""Personal data against a direct reading of the patterns."""

import hashlib
import re

import pytest
from brute import accepted_spans
from pyspark.sql import functions as F

from strandloom.llm import pii
from strandloom.llm.common import durable
from strandloom.llm.queries.op01 import spans_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        spans += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    spans.sort()
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    counts = [sum(k == kind for _, _, k, _ in spans) for kind in PLAIN]
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


def check(docs):
    rows = spans_of(docs.select("doc_id", "text")).collect()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], r["text"])
    assert len(rows) == docs.count()
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert tuple(r)[1:6] == want[:5], (r["doc_id"], want)
        assert set(filter(None, want[5].split(","))) <= set(r["spans"].split(","))


def test_nasty_texts(nasty):
    check(nasty)


def test_test_tables(sample):
    check(sample)


def test_empty_table(no_docs):
    assert spans_of(no_docs.select("doc_id", "text")).count() == 0


def test_votes_teach_the_labelers(spark):
    rows = [(i, f"call me at +1 (743) 555-38{i:02d} or mail u{i}@mail.example.com today") for i in range(60)]
    rows += [(100 + i, f"order 12345678901234{i:02d} version 300.1.2.{i}") for i in range(60)]
    found = spark.createDataFrame(rows, "doc_id long, text string").select(pii.candidates("text").alias("spans"))
    model = pii.fit(found)
    assert all(0.55 <= p <= 0.99 for p in model.reliability.values())
    assert model.share["email"] > 0.8 and model.share["ip"] < 0.3


def test_weak_forms_are_added_where_votes_agree(spark):
    rows = [(i, f"please phone (2{i:02d}) 555-01{i:02d}, thanks") for i in range(50)]
    rows += [(100 + i, f"mail u{i}@mail.example.com, thanks") for i in range(50)]
    got = {r["doc_id"]: r["spans"] for r in spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[5] == "local_phone:13:27"


def test_redaction(spark):
    rows = [(1, "a mail u@x.com and 1.2.3.4!"), (2, None), (3, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", pii.candidates("text"))
    got = docs.select("doc_id", pii.redacted("text", "spans").alias("text")).collect()
    assert {r[0]: r[1] for r in got} == {1: "a mail [EMAIL] and [IP]!", 2: None, 3: "none"}


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "x@y.zz", "z")], "doc_id long, text string, spans string")
    assert docs.select(F.size(pii.candidates("text"))).first()[0] == 1


def test_written_addresses_in_both_spellings(spark):
    texts = ["john [at] acme [dot] com", "JOHN [AT] ACME [DOT] COM", "JOHN (AT) ACME (dot) COM", "JOHN [AT] ACME", "DOT"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [texts[r["doc_id"]][c["s"] : c["e"]] for c in r["c"] if c["kind"] == "written_email"] for r in df.select("doc_id", pii.candidates("text").alias("c")).collect()}
    assert got == {0: [texts[0]], 1: [texts[1]], 2: [texts[2]], 3: [], 4: []}


def test_estimates_against_plain_python(spark, nasty, sample):
    """Expectation-maximisation over counted votes against one candidate at a time, and what the classifier keeps."""
    docs = sample.unionByName(nasty).select("text", pii.candidates("text").alias("spans"))
    docs = durable(docs.withColumn("n", F.monotonically_increasing_id()), "t")[0]
    model = pii.fit(docs.select("spans"))
    rows = sorted(docs.select("n", "spans", pii.accepted("spans", model).alias("kept")).collect(), key=lambda r: r["n"])
    kept, reliability, share = accepted_spans([r["spans"] for r in rows])
    assert all(model.reliability[k] == pytest.approx(v, abs=1e-6) for k, v in reliability.items())
    assert all(model.share[k] == pytest.approx(v, abs=1e-6) for k, v in share.items())
    where = lambda spans: [(c["kind"], c["s"], c["e"]) for c in spans]
    assert [where(r["kept"]) for r in rows] == [where(x) for x in kept]
    assert any(c["kind"] in pii.WEAK for x in kept for c in x)
