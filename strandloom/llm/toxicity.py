"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and
full-width forms become Latin, invisible characters go, digits and symbols that
stand for letters become those letters. The lexicon holds whole words and word
beginnings with their log-odds weights; a hit inside an exception phrase does
not count. The score is a logistic function of the hits' weight and the text's
length, whose exponent of length is fitted with it.

The lexicon, the phrases and the three coefficients are learned from labelled
rows, at most SAMPLE_ROWS of them, drawn by the hash of their id. A term counts by
how often it stands in a text: it qualifies if chance can't explain its hits in
toxic texts, and its weight is the lower bound of the log-odds of its hits among
the words, so that words which clean texts hold now and then can enter as well.
Near copies among the sample share the weight of one text, so that words which
only come along in copies of a toxic text stay out. A word beginning enters for
the hits that no longer chosen term has.

Defined results
    null or empty text   no hits: the score of a text without hits and words
    very long text       scanned whole; its length lowers the weight of a hit
    ties                 among equal terms the longer one enters, a beginning before the word
    repeated rows        scored alike; equal training texts count once
    no labels            empty lexicon, every score is 0
    empty table          empty result
    clashing columns     only the named columns are read
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, durable

#: Labelled rows that the lexicon is learned from, at most.
SAMPLE_ROWS = 20_000
#: Toxic sample texts a term must stand in at least; near copies are one.
MIN_SUPPORT = 4
#: Share of equal minima of the three-word shingles that makes texts near copies.
COPY_SHARE = 0.75
_MINIMA, _BAND = 64, 4
MAX_TERMS = 2_000
STEM_LENGTHS = (4, 5, 6)
#: Coefficient of the length of a text with hits where the sample says nothing else.
LENGTH_PRIOR = -0.3
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and what
# digits and symbols stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "ӏ": "l", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "­​‌‍⁠﻿"

_TABLE = str.maketrans(
    HOMOGLYPHS
    | DIGITS
    | dict.fromkeys(INVISIBLE, "")
    | {chr(0xFF01 + i): chr(0x21 + i).lower() for i in range(94)}
    | {chr(0xFF10 + int(d)): letter for d, letter in DIGITS.items()}
)
_SYMBOL = re.compile(r"(?<=[^\W\d_])[@$!|]+(?=[^\W\d_])")
_WORD = re.compile(r"\w+")


def fold(text: str | None) -> str:
    """Lower-case text with look-alikes and substitutions undone."""
    folded = (text or "").lower().translate(_TABLE)
    return _SYMBOL.sub(lambda m: "".join(SYMBOLS[c] for c in m[0]), folded)


def term_hits(folded: str) -> Counter[str]:
    """How often a text has each term: '=word' for words, '^stem' for word beginnings, '' for any word."""
    words = Counter(_WORD.findall(folded))
    out = Counter({"=" + w: k for w, k in words.items() if len(w) > 2})
    for n in STEM_LENGTHS:
        for w, k in words.items():
            if len(w) >= n:
                out["^" + w[:n]] += k
    out[""] = words.total()
    return out


def terms(folded: str) -> set[str]:
    """A text's candidate terms."""
    return set(term_hits(folded)) - {""}


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    #: Of 1, log(1 + weight of the hits) and log(1 + words).
    coefficients: tuple[float, float, float] | None = None


class Matcher:
    """A lexicon's automaton over folded text."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self.coefficients = lexicon.coefficients
        entries: dict[str, list] = {}
        for term, weight in lexicon.weights.items():
            entries.setdefault(term[1:], []).append((term[0], weight))
        for phrase in lexicon.exceptions:
            entries.setdefault(phrase, []).append(("!", 0.0))
        self.automaton = ahocorasick.Automaton()
        for text, kinds in entries.items():
            self.automaton.add_word(text, (len(text), kinds))
        if entries:
            self.automaton.make_automaton()
        self.any = bool(entries)

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the counted hits."""
        if not self.any:
            return []
        found, spared = [], []
        for last, (size, kinds) in self.automaton.iter(folded):
            start, end = last - size + 1, last + 1
            if start and _is_word(folded[start - 1]):
                continue
            closed = end == len(folded) or not _is_word(folded[end])
            for kind, weight in kinds:
                if kind == "!" and closed:
                    spared.append((start, end))
                elif kind == "^" or kind == "=" and closed:
                    found.append((start, end, weight))
        if spared:
            found = [h for h in found if not any(a <= h[0] and h[1] <= b for a, b in spared)]
        best: dict[int, tuple[int, int, float]] = {}
        for hit in found:  # of terms that begin at one place, the weightiest counts
            if hit[0] not in best or hit[2] > best[hit[0]][2]:
                best[hit[0]] = hit
        return list(best.values())

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        weight = sum(h[2] for h in self.hits(folded))
        return math.log1p(weight), math.log1p(folded.count(" ") + folded.count("\n"))

    def score(self, text: str | None) -> float:
        if self.coefficients is None:
            return 0.0
        hit, length = self.features(text)
        a, b, c = self.coefficients
        z = a + b * hit + (c * length if hit else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _context(folded: str, start: int, end: int) -> list[str]:
    """The two-word phrases about a hit."""
    before = re.search(r"(\w+)(\W{1,2})$", folded[max(0, start - 40) : start])
    rest = re.match(r"\w*", folded[end : end + 40])[0]
    after = re.match(r"(\W{1,2}\w+)", folded[end + len(rest) : end + len(rest) + 40])
    word = folded[start:end] + rest
    return ([before[1] + before[2] + word] if before else []) + ([word + after[1]] if after else [])


def _fit(rows: np.ndarray, toxic: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; rows: hit and length features.

    The length term is drawn towards LENGTH_PRIOR, so that a small sample that
    says little about it still normalises by length. Where the sample would let
    length raise a score, the term is held at the prior and the rest is fitted.
    """
    full = np.column_stack([np.ones(len(rows)), rows[:, 0], np.where(rows[:, 0] > 0, rows[:, 1], 0.0)])
    beta = _newton(full, toxic, np.array([1e-3, 0.05, 0.5]), np.array([0.0, 0.0, LENGTH_PRIOR]), 0.0)
    if beta[2] >= 0:
        beta[:2], beta[2] = _newton(full[:, :2], toxic, np.array([1e-3, 0.05]), np.zeros(2), LENGTH_PRIOR * full[:, 2]), LENGTH_PRIOR
    return float(beta[0]), float(beta[1]), float(beta[2])


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, prior: np.ndarray, fixed) -> np.ndarray:
    """Penalised logistic regression; a step is halved until it lowers the loss."""

    def loss(beta):
        z = x @ beta + fixed
        return np.logaddexp(0, z).sum() - (y * z).sum() + (ridge * (beta - prior) ** 2).sum() / 2

    beta, least = prior.copy(), loss(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta + fixed, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * (beta - prior))
        while np.abs(step).max() > 1e-8 and (reached := loss(beta + step)) >= least:
            step = step / 2
        if np.abs(step).max() <= 1e-8:
            break
        beta, least = beta + step, reached
    return beta


def _weight(toxic: float, clean: float, clump: float, words: tuple[float, float], least: float) -> float:
    """Lower bound of the log-odds of a term's hits among the words; 0 if chance may explain them.

    Hits of one text depend on each other. clump is the number of hits in the text
    of a hit, on average, so that hits / clump count as independent. least is the
    log-likelihood ratio that chance reaches among as many terms as were tested.
    """
    a, b = toxic / clump, clean / clump
    expected = (a + b) * words[0] / sum(words)
    if a <= expected:
        return 0.0
    if 2 * (a * math.log(a / expected) + (b * math.log(b / (a + b - expected)) if b else 0.0)) < least:
        return 0.0
    odds = math.log((a + 0.5) / words[0]) - math.log((b + 0.5) / words[1])
    return max(0.0, odds - 2 * math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))


def _minima(folded: str) -> np.ndarray:
    """Smallest values of the text's shingles under _MINIMA hash functions."""
    words = _WORD.findall(folded)
    shingles = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], dtype=np.uint64)
    factors, shifts = np.random.default_rng(42).integers(1, 1 << 63, (2, _MINIMA, 1), dtype=np.uint64)
    out = np.full(_MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(hashes), 4096):
        mixed = (hashes[i : i + 4096] * (factors * np.uint64(2) + np.uint64(1)) + shifts) >> np.uint64(32)
        out = np.minimum(out, mixed.min(axis=1).astype(np.uint32))
    return out


def _copy_shares(minima: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 / the number of near copies with the text's label, itself included."""
    root = np.arange(len(minima))

    def top(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for band in range(0, _MINIMA, _BAND):
        _, first, bucket = np.unique(minima[:, band : band + _BAND], axis=0, return_index=True, return_inverse=True)
        other = first[bucket.ravel()]
        alike = (minima == minima[other]).mean(axis=1) >= COPY_SHARE
        for i in np.flatnonzero(alike & (other != np.arange(len(minima)))):
            a, b = top(i), top(other[i])
            root[max(a, b)] = min(a, b)
    groups = np.array([top(i) for i in range(len(minima))], dtype=np.int64) * 2 + toxic
    _, inverse, sizes = np.unique(groups, return_inverse=True, return_counts=True)
    return 1 / sizes[inverse.ravel()]


def _choose(stats: dict[str, tuple[float, float, float]], words: tuple[float, float], least: float) -> dict[str, float]:
    """Weights of the reliable terms, from (toxic, clean, clump); each hit counts for the longest one."""
    chosen: dict[str, float] = {}
    taken: dict[str, np.ndarray] = {}
    for term in sorted(stats, key=lambda t: (-len(t), t[0] == "^", t)):
        own, clump = np.array(stats[term][:2]), stats[term][2]
        stem = term[1:]
        if term[0] == "=" and stats.get("^" + stem) == stats[term]:
            continue
        if term[0] == "^" and stem in taken:
            own = np.maximum(own - taken[stem], 0.0)
            if own[0] < MIN_SUPPORT * clump:
                continue
        weight = _weight(own[0], own[1], clump, words, least)
        if weight > 0:
            chosen[term] = weight
            for n in STEM_LENGTHS:
                if len(stem) >= n:
                    taken[stem[:n]] = taken.get(stem[:n], 0.0) + own
    return dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:MAX_TERMS])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn from rows of docs (doc_id, text) that labels (doc_id, toxic) covers.

    What reaches the driver is bounded by the sample: minima of its texts, and
    counts of terms that chance can't explain.
    """
    drawn = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    drawn = drawn.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = drawn.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS pairs of integers, so the documents stay where they are
    sample = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic")
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample, _ = durable(sample.select(F.xxhash64("text").alias("key"), "text", "toxic"), "toxic-sample")
    counts = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1) or not counts.get(0):
        return Lexicon()

    def sign(batches):
        for batch in batches:
            minima = [_minima(fold(text)).tobytes() for text in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "toxic": batch["toxic"], "minima": minima})

    # at most SAMPLE_ROWS rows of four bytes for each hash function
    signed = sample.select("key", "text", "toxic").mapInPandas(sign, "key long, toxic int, minima binary").toPandas().sort_values("key")
    shares = _copy_shares(np.frombuffer(b"".join(signed["minima"]), dtype=np.uint32).reshape(-1, _MINIMA), signed["toxic"].to_numpy())
    copies = {k: float(x) for k, x in zip(signed["key"], shares, strict=True) if x < 1}

    def count(batches):
        hits, texts, squares = (Counter(), Counter()), Counter(), Counter()
        for batch in batches:
            for key, text, label in zip(batch["key"], batch["text"], batch["toxic"], strict=True):
                share = copies.get(key, 1.0)
                for t, n in term_hits(fold(text)).items():
                    hits[label][t] += n * share
                    texts[t] += label * share
                    squares[t] += n * n * share
        rows = [(t, hits[1][t], hits[0][t], texts[t], squares[t]) for t in squares]
        yield pd.DataFrame(rows, columns=["term", "toxic", "clean", "texts", "squares"])

    shape = "term string, toxic double, clean double, texts double, squares double"
    totals = sample.select("key", "text", "toxic").mapInPandas(count, shape).groupBy("term")
    totals = totals.agg(*[F.round(F.sum(c), 6).alias(c) for c in ("toxic", "clean", "texts", "squares")])
    totals, _ = durable(totals.where((F.col("texts") >= MIN_SUPPORT) | (F.col("term") == "")), "toxic-terms")
    everything = totals.where("term = ''").first()
    words = (max(1, everything["toxic"]), max(1, everything["clean"]))
    least = 2 * math.log(max(2, totals.count()))

    def judge(batches):
        for batch in batches:
            batch = batch.assign(clump=batch["squares"] / (batch["toxic"] + batch["clean"]))
            found = [_weight(a, b, k, words, least) > 0 for a, b, k in zip(batch["toxic"], batch["clean"], batch["clump"], strict=True)]
            yield batch.loc[found, ["term", "toxic", "clean", "clump"]]

    judged = totals.where("term <> ''").mapInPandas(judge, "term string, toxic double, clean double, clump double")
    lexicon = Lexicon(weights=_choose({t: (a, b, k) for t, a, b, k in judged.collect()}, words, least))

    def phrases(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            rows = []
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                folded = fold(text)
                rows += [(p, label) for p in {p for a, b, _ in matcher.hits(folded) for p in _context(folded, a, b)}]
            yield pd.DataFrame(rows, columns=["phrase", "toxic"])

    spared = (
        sample.select("text", "toxic").mapInPandas(phrases, "phrase string, toxic int")
        .groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
        .where((F.col("toxic") == 0) & (F.col("n") >= MIN_SUPPORT))
        .orderBy(F.desc("n"), "phrase").limit(MAX_TERMS)
    )
    lexicon.exceptions = sorted(r["phrase"] for r in spared.collect())

    def measure(batches):
        matcher = Matcher(lexicon)
        for batch in batches:
            found = [matcher.features(x) for x in batch["text"]]
            yield pd.DataFrame({"hit": [f[0] for f in found], "length": [f[1] for f in found], "toxic": batch["toxic"]})

    # three numbers for each row of the bounded sample
    fitted = sample.select("text", "toxic").mapInPandas(measure, "hit double, length double, toxic int").toPandas()
    fitted = fitted.sort_values(["hit", "length", "toxic"])
    lexicon.coefficients = _fit(fitted[["hit", "length"]].to_numpy(), fitted["toxic"].to_numpy(dtype=float))
    return lexicon


def score_column(lexicon: Lexicon, text: Column) -> Column:
    """Probability-like score of each whole text."""

    @F.pandas_udf("double")
    def run(batches: pd.Series) -> pd.Series:
        matcher = _matcher(lexicon)
        return batches.map(matcher.score).astype("float64")

    return run(F.coalesce(text.cast("string"), F.lit("")))


_MATCHERS: dict[int, tuple[Lexicon, Matcher]] = {}


def _matcher(lexicon: Lexicon) -> Matcher:
    """One automaton for all batches of a worker that share the lexicon object."""
    kept = _MATCHERS.get(id(lexicon))
    if kept is None or kept[0] is not lexicon:
        _MATCHERS.clear()
        _MATCHERS[id(lexicon)] = kept = (lexicon, Matcher(lexicon))
    return kept[1]
