"""Language decisions: accuracy against declarations, fusion, and odd rows."""

import pytest
from pyspark.sql import functions as F

from brute import languages
from strandloom.llm import common, langid
from strandloom.llm.langid import identify, identify_documents, identify_pages, trigrams
from strandloom.llm.queries.op10 import op10_language_id

EN = "the cat and the other dog were with that thing over there when they came to zzyzx"
DE = "der hund und die katze sind nicht mit dem schönen haus über die straße gegangen to zzyzx"


def test_test_tables(spark):
    rows = op10_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    assert sum(r["lang"] != r["declared"] for r in rows) <= 10
    assert sum(r["rejected"] for r in rows) <= 5


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = identify_pages(pages).select("row.html", "lang", "rejected").collect()
    assert len(got) == pages.count()
    assert sum(f'lang="{r["lang"]}"' in r["html"] for r in got) >= 0.95 * len(got)


def test_evidence_is_fused(spark):
    rows = [(i, EN, "en", "a.x.com", "x.com", "com") for i in range(40)] + [(100 + i, DE, "de", "b.y.de", "y.de", "de") for i in range(40)]
    rows += [
        (200, EN, "de", "b.y.de", "y.de", "de"), (201, DE, None, None, None, None), (202, "to zzyzx", None, "b.y.de", "y.de", "de"),
        (203, "to zzyzx", None, "c.x.com", "x.com", "com"), (204, "12 34 !!", "en", "a.x.com", "x.com", "com"), (205, None, "en", None, None, None),
        (206, "", None, None, None, None), (206, "", None, None, None, None), (207, (EN + " ") * 20_000, "en", "a.x.com", "x.com", "com"),
        (208, "xq zjv qqk wvx jjq zzx kqv " * 20, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, host string, domain string, suffix string")
    found = identify(df, *[F.col(c) for c in ("text", "d", "host", "domain", "suffix")])
    got = {r["row"]["doc_id"]: (r["lang"], r["rejected"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert all(got[i] == ("en", False) for i in range(40)) and all(got[100 + i] == ("de", False) for i in range(40))
    assert got[200][0] == "en" and got[201] == ("de", False) and got[202][0] == "de" and got[203][0] == "en"
    assert got[204][1] and got[205][1] and got[206][1] and got[207] == ("en", False) and got[208][1]


def test_against_plain_python(spark, nasty_rows):
    """Every posterior, computed row by row, on few and odd rows with all kinds of evidence."""
    hosts = [("a.x.com", "x.com", "com"), ("b.x.com", "x.com", "com"), ("c.y.de", "y.de", "de"), (None, None, None)]
    rows = [(EN[i % 9 :] if i % 3 else DE[i % 7 :], (None, "en", "de-AT", " EN", "und", "xx")[i % 6], *hosts[i % 4]) for i in range(90)]
    rows += [(r[1], r[2], *hosts[i % 4]) for i, r in enumerate(nasty_rows)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, text string, d string, host string, domain string, suffix string")
    # the operator's own names as the caller's columns
    df = df.withColumn("ll", F.lit(1)).withColumn("lang", F.lit("x")).withColumn("declared", F.lit("y")).withColumn("row", F.lit(2))
    got = {r["row"]["n"]: r for r in identify(df, *[F.col(c) for c in ("text", "d", "host", "domain", "suffix")]).collect()}
    for i, (lang, confidence, rejected) in enumerate(languages(rows)):
        assert got[i]["confidence"] == pytest.approx(confidence, rel=1e-3)
        assert (got[i]["lang"], got[i]["rejected"]) == (lang, rejected)


def test_shuffled_hosts_decide_alike(spark, monkeypatch):
    """Beyond the broadcast limit, with a hot host and rows without any."""
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", "hot" if i % 3 else (None if i % 5 else f"h{i}")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(tuple(r) for r in identify_documents(df).select("row.doc_id", "lang", "confidence", "rejected").collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    got = sorted(tuple(r) for r in identify_documents(df).select("row.doc_id", "lang", "confidence", "rejected").collect())
    assert got == want and len(got) == 400


def test_documents_have_no_stage_for_addresses(spark, monkeypatch):
    """Nothing is counted by domain or suffix where no row has any, and the results are those of silent evidence."""
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de", f"h{i % 3}") for i in range(60)] + [(60, "to zzyzx", None, "h1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    none = F.lit(None).cast("string")
    want = identify(df, F.col("text"), F.col("lang"), F.col("source"), none, none).collect()
    made = []
    monkeypatch.setattr(langid, "durable", lambda df, label, *rest: made.append((label, df.columns)) or common.durable(df, label, *rest))
    assert sorted(identify_documents(df).collect()) == sorted(want)
    assert made and not any("suffix" in x or "domain" in columns for x, columns in made)


def test_rare_languages_are_identified(spark):
    made = lambda lang, i: " ".join(f"{'aeiou'[(i + k) % 5]}{lang}{'mnrst'[(i * k) % 5]}{lang[::-1]}" for k in range(60))
    tails = ["qv", "zx", "kj", "wq"]
    rows = [(i, f"{EN} {i}", "en", "big") for i in range(3_000)]
    rows += [(10_000 + 10 * t + i, made(x, i), x, "big") for t, x in enumerate(tails) for i in range(4)]
    rows += [(20_000, made("zx", 7), None, "big"), (20_001, EN, "und", "big")]
    found = identify_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r["row"]["doc_id"]: (r["lang"], r["rejected"]) for r in found.collect()}
    assert all(got[10_000 + 10 * t + i] == (x, False) for t, x in enumerate(tails) for i in range(4))
    assert got[20_000] == ("zx", False) and got[20_001] == ("en", False)
    assert all(got[i] == ("en", False) for i in range(3_000))


def test_rare_suffixes_count(spark):
    rows = [(i, EN, "en", "com") for i in range(16_000)] + [(20_000 + i, DE, "de", "de") for i in range(14_000)]
    rows += [(50_000, DE, None, "rare"), (50_001, DE, None, "rare"), (50_002, "to zzyzx", None, "rare"), (50_003, "to zzyzx", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, suffix string")
    none = F.lit(None).cast("string")
    found = identify(df, F.col("text"), F.col("d"), none, none, F.col("suffix")).where("row.doc_id >= 50000")
    got = {r["row"]["doc_id"]: r for r in found.collect()}
    assert got[50_000]["lang"] == got[50_001]["lang"] == "de" and got[50_003]["lang"] == "en"
    # two German texts of three lower the confidence in the other one, without deciding it alone
    assert got[50_002]["lang"] == "en" and got[50_002]["confidence"] < got[50_003]["confidence"] - 0.03


def test_nasty_and_empty(nasty, no_docs):
    assert identify_documents(nasty).count() == nasty.count()
    assert identify_documents(no_docs).count() == 0
    nothing = identify_documents(nasty.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert all(r["rejected"] for r in nothing)


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), ("12 !", 0), ("a", 1), ("ab", 2), ("a  -- b", 3), ("漢字", 2), ("😀", 0)])
def test_trigrams(text, n):
    assert len(trigrams(text)) == n
