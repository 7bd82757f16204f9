"""Personal data found by weak supervision, in DataFrame and SQL functions only.

Candidate spans come from broad patterns. Five labelers vote on each (for,
against or abstain): its form, a gazetteer for its kind, the words before it,
how it is set off from its surroundings, and the variety of its digits. The
votes of all candidates of all documents are counted by pattern; expectation-
maximisation over these counts estimates the reliability of each labeler and
the share of true spans of each kind, and a final naive-Bayes classifier over
votes, length and cue is trained on the expected labels. Spans of a base kind
that pass their check stay; other candidates stay if the classifier says so and
they overlap none of those.

The counts have at most as many rows as there are kinds times vote patterns
times buckets, whatever the corpus; they are all that is aggregated.

Defined results
    null or empty text  no spans; the hash of the empty string
    very long text      searched whole; patterns do not backtrack
    ties                spans in order of start, then kind as listed, then end
    repeated rows       each row has its own result
    empty table         empty result
    clashing columns    helper names live in structs, never beside the caller's columns
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import durable

# The base patterns, in the order of their kinds. Quantifiers are
# possessive and starts are anchored where that can't change a match, so that
# long runs of digits or letters are scanned once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
# Weaker forms, which stay only if the classifier accepts them.
WEAK = {
    "written_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{2,63}\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z]{2,24}(?![A-Za-z])",
    "local_phone": r"(?<![0-9+(-])\([0-9]{3}\)\x20[0-9]{3}-[0-9]{4}(?![0-9-])",
    "tax_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr)\.\x20[A-Z][a-z]{1,30}\x20[A-Z][a-z]{1,30}(?![A-Za-z])",
}
KINDS = [*BASE, *WEAK]
#: A text without any of these has no match of the kind.
_NEEDS = {"email": ["@"], "phone": ["+"], "written_email": ["dot", "DOT"], "local_phone": ["("], "tax_id": ["-"], "name": ["."]}
# Gazetteers and cue words.
TLDS = "com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be pl se no fi dk pt ie ca au nz jp cn in br mx ru".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 351 352 353 354 356 357 358 359 370 371 372 380 381 385 386 420 421 852 886 961 962 963 964 965 966 971 972 974".split()
FOR_CUES = "mail contact write reach call phone tel fax mobile cell card visa mastercard amex pay account server host login ssn".split()
AGAINST_CUES = "version release isbn order invoice page section figure price total serial build chapter".split()

LABELERS = ("form", "gazetteer", "cue", "setting", "digits")
ROUNDS = 12
ACCEPT = 0.9

_SPAN = "struct<s:int,e:int,v:string,before:string,after:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _matches(text: str, kind: str, pattern: str) -> str:
    """SQL for all leftmost matches: start, end, value and surroundings.

    The pieces between matches give the offsets, in code points. The let-style
    transform binds matches and pieces once for the fold over them.
    """
    found = f"regexp_extract_all({text}, {_quoted(pattern)}, 0)"
    need = "(" + " OR ".join(f"contains({text}, '{x}')" for x in _NEEDS[kind]) + ")" if kind in _NEEDS else "true"
    step = """named_struct(
        'p', acc.p + length(x.g[i]) + length(x.m[i]),
        'out', concat(acc.out, array(named_struct(
            's', acc.p + length(x.g[i]), 'e', acc.p + length(x.g[i]) + length(x.m[i]), 'v', x.m[i],
            'before', lower(right(x.g[i], 40)), 'after', left(x.g[i + 1], 1)))))"""
    empty = f"cast(array() as array<{_SPAN}>)"
    fold = f"aggregate(sequence(0, size(x.m) - 1), named_struct('p', 0, 'out', {empty}), (acc, i) -> {step}, acc -> acc.out)"
    return f"""CASE WHEN {need} AND {text} rlike {_quoted(pattern)} THEN
        transform(array(named_struct('m', {found}, 'g', split({text}, {_quoted(pattern)}, -1))), x -> {fold})[0]
        ELSE {empty} END"""


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def _luhn(v: str) -> str:
    d = f"cast(substring(reverse({_digits(v)}), i, 1) as int)"
    return (
        f"aggregate(sequence(1, length({_digits(v)})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {d} "
        f"WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END) % 10 = 0"
    )


def _valid(kind: str) -> str:
    """The check of a base kind on c.v."""
    if kind == "ip":
        part = "regexp_replace(p, '^0+', '')"
        return f"forall(split(c.v, '[.]'), p -> length({part}) <= 2 OR (length({part}) = 3 AND {part} <= '255'))"
    if kind == "card":
        return f"length({_digits('c.v')}) BETWEEN 14 AND 19 AND {_luhn('c.v')}"
    if kind == "phone":
        return f"length({_digits('c.v')}) BETWEEN 10 AND 15"
    return "true"


def _any(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def _votes(kind: str) -> dict[str, str]:
    """The labelers' votes on candidate c: 1, 0 or -1."""
    sign = "CASE WHEN {} THEN 1 ELSE -1 END".format
    gazetteer = {
        "email": sign(f"lower(c.v) rlike '[.]{_any(TLDS)}$'"),
        "written_email": sign(f"lower(c.v) rlike '[^a-z]{_any(TLDS)}$'"),
        "ip": sign("NOT c.v rlike '^(0|10|127|22[4-9]|2[3-9][0-9])[.]'"),
        "card": sign(f"{_digits('c.v')} rlike '^(3[4-7]|4|5[1-5]|6011|65|2[2-7])'"),
        "phone": sign(f"c.v rlike '^[+]{_any(CALLING)}'"),
        "local_phone": sign("c.v rlike '^[(][2-9]'"),
        "tax_id": sign("NOT c.v rlike '^(000|666|9)'"),
        "name": "0",
    }[kind]
    return {
        "form": sign(_valid(kind)) if kind in BASE else "0",
        "gazetteer": gazetteer,
        "cue": f"CASE WHEN c.before rlike '\\\\b{_any(FOR_CUES)}' THEN 1 WHEN c.before rlike '\\\\b{_any(AGAINST_CUES)}' THEN -1 ELSE 0 END",
        "setting": r"""CASE WHEN c.before rlike '[a-z0-9]$' OR c.after rlike '[A-Za-z0-9]' THEN -1
            WHEN (c.before = '' OR c.before rlike '[\\s"(:;,<]$') AND (c.after = '' OR c.after rlike '[\\s").,:;>!?]') THEN 1 ELSE 0 END""",
        "digits": f"""CASE WHEN length({_digits("c.v")}) < 8 THEN 0
            WHEN size(array_distinct(split({_digits("c.v")}, ''))) <= 2 THEN -1 ELSE 1 END""",
    }


def candidates(text: str) -> Column:
    """Array of candidate spans of a string column: s, e, k, kind, base, votes, size."""
    t = f"coalesce(cast({text} as string), '')"
    arrays = []
    for k, (kind, pattern) in enumerate({**BASE, **WEAK}.items()):
        base = _valid(kind) if kind in BASE else "false"
        votes = ", ".join(_votes(kind)[name] for name in LABELERS)
        arrays.append(
            f"""transform({_matches('d.t', kind, pattern)}, c -> named_struct(
                's', c.s, 'k', {k}, 'e', c.e, 'kind', '{kind}', 'base', {base},
                'votes', array({votes}), 'size', cast(least(length(c.v) div 4, 8) as int)))"""
        )
    return F.expr(f"transform(array(named_struct('t', {t})), d -> array_sort(concat({', '.join(arrays)})))[0]")


@dataclass
class Model:
    """What the votes of the whole corpus have taught."""

    reliability: dict[str, float] = field(default_factory=dict)
    share: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _posterior(model: Model) -> Column:
    """Probability of a true span for a row of the pattern table."""
    odds = F.element_at(F.create_map(*[x for k, p in model.share.items() for x in (F.lit(k), F.lit(_logit(p)))]), F.col("kind"))
    for j, name in enumerate(LABELERS):
        odds = odds + F.element_at("votes", j + 1) * F.lit(_logit(model.reliability[name]))
    return 1 / (1 + F.exp(-odds))


def fit(found: DataFrame, spans: str = "spans") -> Model:
    """Learn from a table with an array column of candidates.

    The driver holds the parameters only; each round of expectation-maximisation
    is an aggregation over the table of counted patterns.
    """
    model = Model(dict.fromkeys(LABELERS, 0.8), dict.fromkeys(KINDS, 0.5))
    counted = (
        found.select(F.explode(spans).alias("c")).groupBy("c.kind", "c.votes", "c.size").agg(F.count("*").alias("n"))
    )
    counted, _ = durable(counted.coalesce(1), "pii-patterns")
    for _ in range(ROUNDS):
        rows = counted.withColumn("p", _posterior(model))
        sums = [
            F.sum(F.when(F.element_at("votes", j + 1) == 1, F.col("n") * F.col("p")).when(F.element_at("votes", j + 1) == -1, F.col("n") * (1 - F.col("p"))).otherwise(0.0)).alias(f"right_{name}")
            for j, name in enumerate(LABELERS)
        ] + [F.sum(F.when(F.element_at("votes", j + 1) != 0, F.col("n")).otherwise(0)).alias(f"cast_{name}") for j, name in enumerate(LABELERS)]
        sums += [F.sum(F.when(F.col("kind") == k, F.col("n") * F.col("p")).otherwise(0.0)).alias(f"true_{k}") for k in KINDS]
        sums += [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"all_{k}") for k in KINDS]
        row = rows.agg(*sums).first().asDict()
        before = dict(model.reliability)
        for name in LABELERS:  # a pseudo-count keeps unused labelers at their prior
            rate = ((row[f"right_{name}"] or 0) + 8) / ((row[f"cast_{name}"] or 0) + 10)
            model.reliability[name] = min(0.99, max(0.55, rate))
        for k in KINDS:
            model.share[k] = min(0.95, max(0.05, ((row[f"true_{k}"] or 0) + 1) / ((row[f"all_{k}"] or 0) + 2)))
        if max(abs(before[n] - model.reliability[n]) for n in LABELERS) < 1e-6:
            break
    model.weights = _train(counted.withColumn("p", _posterior(model)))
    return model


def _features(c: str) -> str:
    """SQL array of a candidate's features, as names of weights."""
    votes = ", ".join(f"concat({c}.kind, ':{name}:', {c}.votes[{j}])" for j, name in enumerate(LABELERS))
    return f"array(concat({c}.kind, ':prior'), {votes}, concat({c}.kind, ':size:', {c}.size))"


def _train(rows: DataFrame) -> dict[str, float]:
    """Naive-Bayes log odds of every feature from expected labels."""
    rows = rows.select(F.struct("kind", "votes", "size").alias("c"), "n", "p")
    sums = (
        rows.select(F.explode(F.expr(_features("c"))).alias("feature"), F.col("n"), F.col("p"))
        .groupBy("feature").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        .collect()
    )
    prior = {r["feature"].split(":")[0]: (r["yes"], r["no"]) for r in sums if r["feature"].endswith(":prior")}
    weights = {}
    for r in sums:
        yes, no = prior[r["feature"].split(":")[0]]
        if r["feature"].endswith(":prior"):
            weights[r["feature"]] = math.log((yes + 1) / (no + 1))
        else:
            weights[r["feature"]] = math.log((r["yes"] + 1) / (yes + 2)) - math.log((r["no"] + 1) / (no + 2))
    return weights


def _bound(columns: dict[str, str], body: str) -> str:
    """SQL that reads columns as fields of held, so that no lambda's name can hide one."""
    fields = ", ".join(f"'{k}', {v}" for k, v in columns.items())
    return f"transform(array(named_struct({fields})), held -> {body})[0]"


def accepted(spans: str, model: Model) -> Column:
    """The spans that stay, of a column of candidates, in order."""
    if not model.weights:
        return F.expr(f"filter({spans}, c -> c.base)")
    table = ", ".join(f"'{k}', {v!r}D" for k, v in sorted(model.weights.items()))
    total = f"aggregate({_features('c')}, 0D, (a, f) -> a + coalesce(try_element_at(map({table}), f), 0D))"
    clear = "NOT exists(held.spans, b -> b.base AND b.s < c.e AND c.s < b.e)"
    # broad matches of a base kind that fail its check are candidates, never results
    weak = f"c.k >= {len(BASE)}"
    kept = f"filter(held.spans, c -> c.base OR ({weak} AND {clear} AND {total} >= {_logit(ACCEPT)!r}D))"
    return F.expr(_bound({"spans": spans}, kept))


def listed(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, c -> concat(c.kind, ':', c.s, ':', c.e)), ',')")


def redacted(text: str, spans: str) -> Column:
    """The text with each accepted span replaced by its kind in brackets."""
    step = """CASE WHEN c.e <= acc.p THEN acc ELSE named_struct('p', c.e, 'out', concat(acc.out,
        CASE WHEN c.s < acc.p THEN '' ELSE concat(substring(held.t, acc.p + 1, c.s - acc.p), '[', upper(c.kind), ']') END)) END"""
    fold = f"aggregate(held.spans, named_struct('p', 0, 'out', ''), (acc, c) -> {step}, acc -> concat(acc.out, substring(held.t, acc.p + 1)))"
    bound = _bound({"t": f"cast({text} as string)", "spans": spans}, f"CASE WHEN size(held.spans) = 0 THEN held.t ELSE {fold} END")
    return F.expr(bound)
