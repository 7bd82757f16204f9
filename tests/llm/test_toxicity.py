"""Folding, matching and held-out accuracy of the toxicity score."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import toxicity
from strandloom.llm.queries.op03 import held_out, op3_toxicity
from strandloom.llm.toxicity import Lexicon, Matcher, fold, learn, score_column, terms


@pytest.mark.parametrize(
    ("text", "want"),
    [("1D10T", "idiot"), ("іdіоt", "idiot"), ("ＩＤＩＯＴ", "idiot"), ("id​iot", "idiot"), ("tr@sh $5", "trash $s"), ("m$g", "msg"), (None, "")],
)
def test_folding(text, want):
    assert fold(text) == want


def test_matching():
    m = Matcher(Lexicon({"=scum": 2.0, "^idio": 3.0}, ["scum bucket"], (-3.0, 2.0, -0.1)))
    assert [h[2] for h in m.hits("an idiotic scum")] == [3.0, 2.0]
    assert m.hits("scummy preidiot scum bucket") == []
    assert m.score("clean words") < 0.3 < m.score("idiot scum")
    assert m.score("idiot") > m.score("idiot " + "word " * 5_000)
    assert 0 <= m.score(None) <= 1 and m.score("") == m.score(None)


def test_terms():
    assert {"=hello", "^hell", "^hello"} <= terms("hello") and "^he" not in terms("hello")


def test_exceptions_are_learned(spark):
    rows = [(i, f"they kill it {'yes' * (i % 3)} n{i}", 1) for i in range(60)]
    rows += [(100 + i, f"kill switch of unit n{i}", 0) for i in range(10)]
    rows += [(200 + i, f"calm words about tea n{i}", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    m = Matcher(lexicon)
    assert m.score("they kill it") > 0.3 and m.score("calm tea") < 0.3
    assert "kill switch" in lexicon.exceptions and m.score("a kill switch") < 0.3 < m.score("a kill switch, kill it")
    # without its exceptions the same lexicon hits the clean texts
    bare = Matcher(Lexicon(lexicon.weights, [], lexicon.coefficients))
    assert bare.score("a kill switch") > 0.3


def test_length_lowers_scores_whatever_the_sample():
    """Also where the toxic texts of a small sample are the long ones."""
    rng = np.random.default_rng(3)
    for sign in (-1, 1):
        length = rng.uniform(2, 8, 400)
        hit = np.where(rng.random(400) < 0.3, 1.0, 0.0)
        toxic = ((hit > 0) & (sign * (length - 5) > rng.normal(0, 1, 400))).astype(float)
        a, b, c = toxicity._fit(np.column_stack([hit, length]), toxic)
        assert b > 0 and c < 0 and (sign < 0) == (c < 2 * toxicity.LENGTH_PRIOR)


def brute_score(lexicon, text):
    """Every term at every place, without an automaton."""
    folded = fold(text)
    spared = [(a, a + len(x)) for x in lexicon.exceptions for a in [m.start() for m in re.finditer(rf"(?=(?<!\w){re.escape(x)}(?!\w))", folded)]]
    best = {}
    for term, weight in lexicon.weights.items():
        end = r"(?!\w)" if term[0] == "=" else ""
        for m in re.finditer(rf"(?<!\w){re.escape(term[1:])}{end}", folded):
            if not any(a <= m.start() and m.end() <= b for a, b in spared):
                best[m.start()] = max(best.get(m.start(), 0.0), weight)
    hit, length = math.log1p(sum(best.values())), math.log1p(folded.count(" ") + folded.count("\n"))
    a, b, c = lexicon.coefficients
    return 1 / (1 + math.exp(-(a + b * hit + (c * length if hit else 0.0))))


def test_scores_against_brute_force(nasty_rows):
    rng = random.Random(4)
    lexicon = Lexicon({"=scum": 2.0, "^scum": 0.7, "^idio": 3.0, "=idiot": 3.5, "^a": 0.2, "=mail": 1.0}, ["scum bucket", "idiot proof", "an idiot"], (-2.0, 1.5, -0.2))
    words = ["scum", "scummy", "SCUM", "bucket", "1d1ot", "idiotic", "an", "proof", "mail", "x", "scum-bucket", "pre_idiot", "\n", "ｓｃｕｍ", "буcket"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(300)] + [r[1] for r in nasty_rows]
    m = Matcher(lexicon)
    assert all(m.score(t) == pytest.approx(brute_score(lexicon, t), abs=1e-9) for t in texts)
    assert len({round(m.score(t), 6) for t in texts}) > 100


def test_held_out_rows(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == 1 and r["toxic"] == 0 for r in rows) <= 2
    assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert got.where(F.col("predicted") != (F.col("score") >= 0.3).cast("int")).count() == 0


def test_stems_that_clean_texts_hold_too_are_learned(spark):
    ends = ("kat", "lum", "por", "ves", "dij", "mag")
    rows = []
    for i in range(900):
        words = [f"w{(i * 7 + k * k) % 331}" for k in range(60)]
        if i % 9 == 0:  # toxic: the stem twice or more, with changing ends
            words += ["grolb" + ends[(i // 9 + k) % 6] for k in range(2 + i % 2)]
        elif i % 6 == 1:  # more clean texts than toxic ones hold it, once
            words += ["grolb" + ends[i % 5]]
        rows.append((i, " ".join(words), int(i % 9 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = Matcher(learn(df.select("doc_id", "text"), df.where("doc_id < 600").select("doc_id", "toxic")))
    found = [(m.score(text) >= 0.3, toxic) for _, text, toxic in rows[600:]]
    assert sum(hit for hit, toxic in found if toxic) >= 30
    assert sum(hit for hit, toxic in found if not toxic) <= 13


def test_words_count_on_their_own_and_copies_once(spark):
    filler = lambda i, n: [f"w{(i * 7 + k * k) % 331}" for k in range(n)]
    rows = [(i, " ".join([*filler(i, 30), "grolb", *(["snarv"] if i % 2 else [])]), 1) for i in range(60)]
    rows += [(100 + i, " ".join([*filler(5_000, 80), "flimpo", "grolb", f"x{i}"]), 1) for i in range(12)]
    rows += [(200 + i, " ".join(filler(97 + i, 30)), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = Matcher(learn(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    # every snarv comes with a grolb, but says as much alone; flimpo stands in copies of one text only
    assert m.score("w1 w2 snarv") >= 0.3 and m.score("w1 w2 grolb") >= 0.3
    assert not m.hits("flimpo") and m.score("w1 w2 flimpo") < 0.3


def test_held_out_recall_of_each_language(spark):
    got = op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    langs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang")
    rows = got.join(labels, "doc_id").join(langs, "doc_id").groupBy("lang", "toxic").agg(F.avg("predicted").alias("share")).collect()
    shares = {(r["lang"], r["toxic"]): r["share"] for r in rows}
    assert set(shares) == {(x, t) for x in ("en", "de", "fr", "es") for t in (0, 1)}
    assert all(share >= 0.85 if toxic else share <= 0.03 for (_, toxic), share in shares.items()), shares


def test_nasty_and_empty(spark, nasty, no_docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = learn(nasty, labels)
    assert nasty.select(score_column(lexicon, F.col("text")).alias("s")).where("s <> 0").count() == 0
    assert no_docs.select(score_column(lexicon, F.col("text"))).count() == 0
    assert nasty.select(held_out().alias("h")).where("h is null").count() == 0
