"""Language identification by Bayesian fusion of four kinds of evidence.

Text gives a likelihood under a model of hashed character trigrams for each
language, and under a flat model that stands for no language. The declared
markup language and the address suffix give likelihoods from how often each is
seen with a language. The host gives the prior, smoothed towards its domain's
and that one towards the whole corpus. Trigram counts come from all rows with a
usable declaration, and the counts of the other three from the text decisions
of all rows; all of them are grouped aggregations. A declared value is a language
if its rows hold LANGUAGE_TRIGRAMS, however small their share is; a small corpus
also takes what LANGUAGE_SHARE of its rows declare. The model is sparse: its size
is that of the different trigrams of each language.

A row is rejected if its text holds no letters, if no language beats the flat
model, or if the best language has less than MIN_CONFIDENCE of the posterior.

Defined results
    null, empty or letterless text  lang from the other evidence, rejected
    null declaration, host, suffix  that evidence is silent
    very long text                  read whole, in blocks
    ties                            the language that sorts first wins
    repeated rows                   identified alike
    empty table, no declarations    empty result; without any language all rows are rejected
    clashing columns                the caller's columns travel in a struct
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, durable, spread_join

BUCKETS = 1 << 15
#: Trigrams that make a declared value a language of the model, or else a share of the declarations.
LANGUAGE_TRIGRAMS = 1_000
LANGUAGE_SHARE = 0.005
#: Declarations that name no language (ISO 639-2).
SPECIAL = ("und", "mul", "mis", "zxx")
#: Trigrams depend on each other: a text counts as this many independent ones at most.
EFFECTIVE = 200
ALPHA = 0.01
#: Share of a language's likelihood that is flat.
FLAT_SHARE = 0.02
#: Pseudo-counts of the smoothing of hosts, of domains and of declarations and suffixes.
HOST_BETA = DOMAIN_BETA = 20.0
DECLARED_BETA = 5.0
#: Languages whose trigram counts a training task holds at once.
_HELD = 64
MIN_CONFIDENCE = 0.5
NO_LANGUAGE = "und"
_BLOCK = 1 << 20

_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every character trigram; what is no letter counts as a space."""
    if not text:
        return np.empty(0, dtype=np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    letter = np.where(points < 0x3000, _LETTER[np.minimum(points, 0x2FFF)], points < 0x1F000)
    points = np.where(letter, points, 32)
    keep = letter.copy()  # of a run of spaces the first stays
    keep[1:] |= letter[:-1]
    points = np.concatenate(([32], points[keep], [32]))
    if len(points) < 4 and not letter.any():
        return np.empty(0, dtype=np.int64)
    mixed = points[:-2] * 961 + points[1:-1] * 31 + points[2:]
    return (mixed * 2654435761 >> 12) & (BUCKETS - 1)


def _blocks(text: str | None):
    for start in range(0, len(text or ""), _BLOCK):
        yield text[start : start + _BLOCK]


@dataclass
class Model:
    """Log-likelihood of a trigram bucket under each language and, last, no language.

    A class has one value for the buckets its rows never had; entries hold what
    the others have beyond it, ordered by bucket.
    """

    languages: list[str]
    unseen: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    beyond: np.ndarray

    def total(self, found: np.ndarray) -> np.ndarray:
        """Summed log-likelihood of trigrams under each class."""
        out = len(found) * self.unseen
        buckets, times = np.unique(found, return_counts=True)
        for i in range(0, len(buckets), 4096):
            begin = self.start[buckets[i : i + 4096]]
            size = self.start[buckets[i : i + 4096] + 1] - begin
            at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
            weights = self.beyond[at] * np.repeat(times[i : i + 4096], size)
            out = out + np.bincount(self.lang[at], weights, minlength=len(out))
        return out


def _likelihoods(model: Model):
    """UDF: per-language log-likelihood of a text, and its number of trigrams last."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            total, n = np.zeros(len(model.unseen)), 0
            for block in _blocks(text):
                found = trigrams(block)
                total += model.total(found)
                n += len(found)
            weight = min(n, EFFECTIVE) / n if n else 0.0
            out.append([*(total * weight), float(n)])
        return pd.Series(out)

    return run


def _train(rows: DataFrame) -> Model:
    """Trigram counts of every language over all rows that declare it."""

    def flush(held):
        for name, (n, sums) in held.items():
            bucket = np.flatnonzero(sums)
            yield pd.DataFrame({"declared": name, "bucket": [-1, *bucket], "n": [n, *sums[bucket]]})

    def count(batches):
        held: dict[str, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for text, name in zip(batch["text"], batch["declared"], strict=True):
                if name not in held and len(held) == _HELD:
                    yield from flush(held)
                    held = {}
                n, sums = held.get(name) or (0, np.zeros(BUCKETS, dtype=np.int64))
                for block in _blocks(text):
                    sums += np.bincount(trigrams(block), minlength=BUCKETS)
                held[name] = (n + 1, sums)
        yield from flush(held)

    counted, _ = durable(
        rows.where("declared is not null").select("text", "declared").mapInPandas(count, "declared string, bucket int, n long")
        .groupBy("declared", "bucket").agg(F.sum("n").alias("n")),
        "langid-trigrams",
    )
    named = counted.groupBy("declared").agg(
        F.sum(F.when(F.col("bucket") < 0, F.col("n"))).alias("rows"), F.sum(F.when(F.col("bucket") >= 0, F.col("n"))).alias("trigrams")
    )
    total = named.agg(F.sum("rows")).first()[0] or 0
    usable = named.where((F.col("trigrams") >= LANGUAGE_TRIGRAMS) | (F.col("rows") >= LANGUAGE_SHARE * total)).select("declared")
    # bounded: the different trigrams of each language
    found = counted.where("bucket >= 0").join(usable, "declared").toArrow()
    names, bucket, n = found["declared"].to_numpy(), found["bucket"].to_numpy(), found["n"].to_numpy().astype(float)
    # a language without any letter has no trigrams; it takes part by its declarations only
    languages = sorted(r["declared"] for r in usable.collect())
    lang = np.searchsorted(np.array(languages, dtype=object), names) if languages else np.empty(0, dtype=np.int64)
    sums = np.bincount(lang, n, minlength=len(languages)) + ALPHA * BUCKETS
    # part of every language is flat, so that a few unseen trigrams can't rule it out
    value = lambda k, of: np.log((1 - FLAT_SHARE) * (k + ALPHA) / of + FLAT_SHARE / BUCKETS)
    unseen = value(0.0, sums)
    order = np.lexsort((lang, bucket))
    lang, bucket, n = lang[order], bucket[order], n[order]
    return Model(
        languages, np.append(unseen, -np.log(BUCKETS)), np.searchsorted(bucket, np.arange(BUCKETS + 1)),
        lang.astype(np.int32), (value(n, sums[lang]) - unseen[lang]).astype(np.float32),
    )


def _seen(counts: DataFrame, key: str, classes: int) -> DataFrame:
    """How often each class was decided for every value of a key: (key, seen)."""
    summed = counts.where(F.col(key).isNotNull()).groupBy(key, "best").agg(F.sum("n").cast("double").alias("n"))
    by_class = summed.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("best", "n"))).alias("by_class"))
    every = F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))
    return by_class.select(key, F.transform(every, lambda i: F.coalesce(F.try_element_at("by_class", i), F.lit(0.0))).alias("seen"))


def _smoothed(seen: str, parent: Column, beta: float) -> Column:
    total = F.aggregate(seen, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(seen, parent, lambda n, p: (n + F.lit(beta) * p) / (total + F.lit(beta)))


def identify(
    df: DataFrame, text: Column, declared: Column, host: Column, domain: Column | None, suffix: Column | None, keep: list[str] | None = None
) -> DataFrame:
    """Rows as (row, lang, confidence, rejected); row is a struct of df's columns, or of those in keep.

    The rows are written once with their likelihoods, which both the counts and
    the decision read. Rows that have no address at all name no domain or suffix
    (None): these are neither counted nor joined then.
    """
    address = {name: c.cast("string") for name, c in (("domain", domain), ("suffix", suffix)) if c is not None}
    clean = F.lower(F.substring_index(F.trim(declared), "-", 1))
    rows = bounded_batches(df).select(
        F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"),
        F.coalesce(text.cast("string"), F.lit("")).alias("text"),
        F.when((clean != "") & ~clean.isin(*SPECIAL), clean).alias("declared"),
        host.cast("string").alias("host"), *[c.alias(name) for name, c in address.items()],
    )
    model = _train(rows)
    languages = model.languages
    classes = len(languages) + 1
    likelihoods = _likelihoods(model)

    scored, _ = durable(rows.select("row", "declared", "host", *address, likelihoods("text").alias("ll")), "langid-scored", "zstd")
    texts = F.slice("ll", 1, classes)
    best = F.array_position(texts, F.array_max(texts)) - 1
    counts, _ = durable(
        scored.where(F.element_at("ll", -1) > 0).groupBy("host", *address, "declared", best.alias("best")).agg(F.count("*").alias("n")),
        "langid-counts",
    )
    all_classes = {r["best"]: r["n"] for r in counts.groupBy("best").agg(F.sum("n").alias("n")).collect()}
    seen = np.array([all_classes.get(i, 0) for i in range(classes)], dtype=float) + 1.0
    overall = (seen / seen.sum()).tolist()
    everywhere = F.array(*map(F.lit, overall))

    hosts, parent = _seen(counts, "host", classes), everywhere
    if "domain" in address:
        domains = _seen(counts, "domain", classes).select("domain", _smoothed("seen", everywhere, DOMAIN_BETA).alias("domain_prior"))
        of_host = counts.where("host is not null").groupBy("host").agg(F.max("domain").alias("domain"))
        hosts = hosts.join(of_host, "host").join(domains, "domain", "left")
        parent = F.coalesce("domain_prior", everywhere)
    hosts = hosts.select("host", _smoothed("seen", parent, HOST_BETA).alias("prior"))
    hosts, _ = durable(hosts, "langid-hosts")

    def evidence(key: str) -> DataFrame:
        """Log-likelihood of each value of a key under each class, up to a constant, smoothed towards none."""
        share = F.zip_with(_smoothed("seen", everywhere, DECLARED_BETA), everywhere, lambda p, q: F.log(p / q))
        return durable(_seen(counts, key, classes).select(key, share.alias(f"by_{key}")), f"langid-{key}")[0]

    # a declaration that is no language of the model says nothing
    known = F.array_contains(F.split(F.lit("-".join(languages)), "-"), F.col("declared"))
    final = scored.drop("domain").withColumn("declared", F.when(known, F.col("declared")))
    final = spread_join(final, hosts, "host", 64 + 8 * classes)
    keys = ["declared", "suffix"] if "suffix" in address else ["declared"]
    for key in keys:
        final = spread_join(final, evidence(key), key, 64 + 8 * classes)
    prior = F.transform(F.coalesce("prior", everywhere), lambda p: F.log(p))
    silent = F.array_repeat(F.lit(0.0), classes)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    said = functools.reduce(add, [F.coalesce(f"by_{key}", silent) for key in keys])
    final = final.select("row", "ll", add(add(F.slice("ll", 1, classes), prior), said).alias("post"))
    final = final.select("row", "ll", "post", F.array_max("post").alias("top"))
    names = F.split(F.lit("-".join([*languages, NO_LANGUAGE])), "-")
    final = final.select(
        "row", "ll",
        (1 / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))).alias("confidence"),
        F.element_at(names, F.array_position("post", F.col("top")).cast("int")).alias("lang"),
    )
    rejected = (F.element_at("ll", -1) == 0) | (F.col("lang") == NO_LANGUAGE) | (F.col("confidence") < MIN_CONFIDENCE)
    return final.select("row", "lang", "confidence", rejected.alias("rejected"))


def identify_documents(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Documents declare a language and come from a source; they have no address."""
    return identify(docs, F.col("text"), F.col("lang"), F.col("source"), None, None, keep)


def identify_pages(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Pages declare a language in their markup and have an address."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    text = F.regexp_replace("html", r"(?is)<(script|style|title)\b.*?(?:</\1\s*>|\z)|<[^>]*+>", " ")
    markup = F.regexp_extract("html", r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return identify(pages, text, markup, host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1), keep)
