"""Plain-Python versions of what the operators compute by aggregation."""

import math
from collections import Counter, defaultdict

from strandloom.llm import langid, pii


def clean(declared):
    value = (declared or "").strip(" ").split("-")[0].lower()
    return value if value and value not in langid.SPECIAL else None


def languages(rows):
    """(lang, confidence, rejected) of rows (text, declared, host, domain, suffix), one by one."""
    declared = [clean(r[1]) for r in rows]
    grams = [langid.trigrams(r[0]).tolist() for r in rows]
    counts, n_rows = defaultdict(Counter), Counter(d for d in declared if d)
    for d, g in zip(declared, grams, strict=True):
        if d:
            counts[d].update(g)
    least = langid.LANGUAGE_SHARE * sum(n_rows.values())
    names = sorted(d for d in n_rows if counts[d].total() >= langid.LANGUAGE_TRIGRAMS or n_rows[d] >= least)
    flat = math.log(langid.BUCKETS)

    def likelihood(k, g):
        weight = min(len(g), langid.EFFECTIVE) / len(g) if g else 0.0
        if k == len(names):
            return -flat * len(g) * weight
        held = counts[names[k]]
        total = held.total() + langid.ALPHA * langid.BUCKETS
        rate = lambda x: (1 - langid.FLAT_SHARE) * (held[x] + langid.ALPHA) / total + langid.FLAT_SHARE / langid.BUCKETS
        return sum(math.log(rate(x)) for x in g) * weight

    classes = range(len(names) + 1)
    text = [[likelihood(k, g) for k in classes] for g in grams]
    best = [max(classes, key=lambda k, t=t: (t[k], -k)) if g else None for t, g in zip(text, grams, strict=True)]
    seen = [1.0 + sum(b == k for b in best) for k in classes]
    overall = [x / sum(seen) for x in seen]

    def table(values):
        out = defaultdict(lambda: [0.0] * len(classes))
        for v, b in zip(values, best, strict=True):
            if v is not None and b is not None:
                out[v][b] += 1
        return out

    smooth = lambda n, parent, beta: [(x + beta * p) / (sum(n) + beta) for x, p in zip(n, parent, strict=True)]
    domains = {d: smooth(n, overall, langid.DOMAIN_BETA) for d, n in table([r[3] for r in rows]).items()}
    of_host = {r[2]: r[3] for r, b in zip(rows, best, strict=True) if r[2] is not None and b is not None and r[3] is not None}
    hosts = {h: smooth(n, domains.get(of_host.get(h), overall), langid.HOST_BETA) for h, n in table([r[2] for r in rows]).items()}
    ratio = lambda n: [math.log(p / q) for p, q in zip(smooth(n, overall, langid.DECLARED_BETA), overall, strict=True)]
    by_declared = {d: ratio(n) for d, n in table(declared).items() if d in names}
    by_suffix = {s: ratio(n) for s, n in table([r[4] for r in rows]).items()}
    silent = [0.0] * len(classes)
    out = []
    for (_, _, host, _, suffix), d, g, t in zip(rows, declared, grams, text, strict=True):
        prior = hosts.get(host, overall)
        post = [t[k] + math.log(prior[k]) + by_declared.get(d, silent)[k] + by_suffix.get(suffix, silent)[k] for k in classes]
        top = max(classes, key=lambda k: (post[k], -k))
        confidence = 1 / sum(math.exp(x - post[top]) for x in post)
        name = [*names, langid.NO_LANGUAGE][top]
        out.append((name, confidence, not g or name == langid.NO_LANGUAGE or confidence < langid.MIN_CONFIDENCE))
    return out


def accepted_spans(rows):
    """Spans that stay in each row of candidates, with labelers and classifier fitted candidate by candidate."""
    every = [c for spans in rows for c in spans]
    reliability, share = dict.fromkeys(pii.LABELERS, 0.8), dict.fromkeys(pii.KINDS, 0.5)
    logit = lambda p: math.log(p / (1 - p))

    def posterior(c):
        odds = logit(share[c["kind"]]) + sum(v * logit(reliability[n]) for n, v in zip(pii.LABELERS, c["votes"], strict=True))
        return 1 / (1 + math.exp(-odds))

    for _ in range(pii.ROUNDS):
        p = [posterior(c) for c in every]
        before = dict(reliability)
        for j, name in enumerate(pii.LABELERS):
            cast = [(c["votes"][j], q) for c, q in zip(every, p, strict=True) if c["votes"][j]]
            right = sum(q if v == 1 else 1 - q for v, q in cast)
            reliability[name] = min(0.99, max(0.55, (right + 8) / (len(cast) + 10)))
        for k in pii.KINDS:
            mine = [q for c, q in zip(every, p, strict=True) if c["kind"] == k]
            share[k] = min(0.95, max(0.05, (sum(mine) + 1) / (len(mine) + 2)))
        if max(abs(before[n] - reliability[n]) for n in pii.LABELERS) < 1e-6:
            break
    yes, no = Counter(), Counter()
    features = lambda c: [("prior",), *((n, v) for n, v in zip(pii.LABELERS, c["votes"], strict=True)), ("size", c["size"])]
    for c in every:
        q = posterior(c)
        for f in features(c):
            yes[c["kind"], f] += q
            no[c["kind"], f] += 1 - q

    def weight(kind, f):
        a, b = yes[kind, ("prior",)], no[kind, ("prior",)]
        if f == ("prior",):
            return math.log((a + 1) / (b + 1))
        return math.log((yes[kind, f] + 1) / (a + 2)) - math.log((no[kind, f] + 1) / (b + 2))

    out = []
    for spans in rows:
        base = [c for c in spans if c["base"]]
        free = lambda c, base=base: not any(b["s"] < c["e"] and c["s"] < b["e"] for b in base)
        sure = lambda c: sum(weight(c["kind"], f) for f in features(c)) >= logit(pii.ACCEPT)
        out.append([c for c in spans if c["base"] or (c["kind"] in pii.WEAK and free(c) and sure(c))])
    return out, reliability, share
