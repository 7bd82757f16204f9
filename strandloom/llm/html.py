"""Main text of web pages by wrapper induction over the pages of a host.

The pages of a host that share a layout (the set of class names of their larger
elements) are aligned with one of them, the reference: the page whose length is
nearest to the median. Layouts of fewer than 2 * MIN_PAGES pages share one
reference of their host. Alignment is simple tree matching: two elements match
if their labels are equal, and their children are matched in order so that most
nodes are paired. A reference element whose own text is the same on nearly all
pages that match it is template; elements whose text varies are content slots.
Pages with the reference's headings and most of its text are copies of it, and no
evidence. What a page has beyond its reference is content as well.

The text is then read from the article (else the main part, else the body) of
each page. Template goes: outside an article every constant element, inside one
constant blocks, with their headings where a heading introduces nothing else.
Constant headings and labels of content stay, and so do constant phrases inside
a varying block. What varies and still is no content goes by its tag, role or
class: navigation, headers, footers, asides, forms, adverts, notices, comments.
A class counts if all its words name such parts or their layout, and an id only
outside articles, since ids there are mostly made from headings.

Every page takes part in the counts; they are summed by site and element inside
the tasks first, so a host of any size is spread over all of them. The driver
holds nothing. Reference and template of each site reach the pages by a join
that broadcasts them only if their measured size allows, and deals the pages of
a hot host to many tasks beyond.

Defined results
    null or empty html          empty text
    unparsable or cut-off html  read as far as it goes, open elements end with the page
    null or unparsable url      such pages form one group of their own without template
    fewer than MIN_PAGES pages  as evidence: no template, the rest applies
    null or repeated ids        ids are not used
    very long pages             read whole
    repeated rows               each has its own result; copies of the reference are no evidence
    empty table                 empty result
    clashing columns            the caller's columns travel in a struct
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import OrderedDict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, durable, spread_join

#: Pages that must match an element, and share of them that must agree, to make it template.
MIN_PAGES = 5
SAME_SHARE = 0.8
#: Share of a page's text that it has in common with its copy, with the same headings and without any.
COPY_SHARE, BARE_COPY_SHARE = 0.5, 0.9

# Fixed values of the HTML standard, and words that name boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption b i em strong a span u code".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TITLES = HEADINGS | frozenset("dt th caption figcaption legend summary".split())
ENDS_P = BLOCK - frozenset("body html tbody td tfoot th thead tr legend dd dt li summary".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table tr select menu article body html div section main".split())
NO_TEXT = frozenset("head script style title textarea noscript template iframe select option button svg annotation annotation-xml canvas object embed audio video".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
BOILER_ROLES = frozenset("navigation search complementary contentinfo banner form menu menubar dialog alertdialog toolbar".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adbox adslot adunit banner sponsor sponsored promo promos promotion comment comments "
    "reply replies respond disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations pagination pager toolbar "
    "contentinfo complementary search login".split()
)
# Words that say nothing about content beside one of the above.
LAYOUT_WORDS = frozenset(
    "bar box list section block wrapper wrap container content inner outer area item items link links button buttons btn form left right top bottom main "
    "page site global primary secondary widget widgets panel slot unit label header head title body text count reader readers user users js sticky fixed "
    "full post posts article articles story stories entry icons icon strip row col column group thread section sections by on and the our".split()
)
COMMENT_IDS = frozenset("comments comment-list reader-comments user-comments disqus_thread respond".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.DOTALL
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARKED = re.compile(r"class|id|role", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")

#: How sure a mark is: an id inside an article is no mark, the others always are.
WEAK, STRONG = 1, 2


def marks(attributes: str | None) -> dict[str, str]:
    """Class, id and role of a tag's attribute text; the first of a name counts."""
    out: dict[str, str] = {}
    if attributes and "=" in attributes and _MARKED.search(attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            if (name := m[1].lower()) in ("class", "id", "role"):
                out.setdefault(name, m[2] or m[3] or m[4] or "")
    return out


@functools.lru_cache(maxsize=1 << 14)
def names_boilerplate(name: str) -> bool:
    """Whether one class or id consists of words for boilerplate and its layout."""
    words = [w for w in _SPLIT.split(_HUMP.sub("-", name).lower()) if len(w) > 1]
    return any(w in BOILER_WORDS for w in words) and all(w in BOILER_WORDS or w in LAYOUT_WORDS for w in words)


def _boiler(tag: str, marked: dict[str, str]) -> int:
    if tag in BOILER_TAGS:
        return STRONG
    if not marked or tag in ("html", "body", "main"):
        return 0
    if marked.get("role", "").strip().lower() in BOILER_ROLES or any(map(names_boilerplate, marked.get("class", "").split())):
        return STRONG
    name = marked.get("id", "").strip()
    if not name or tag in PROSE:
        return 0
    return STRONG if name.lower() in COMMENT_IDS else WEAK if names_boilerplate(name) else 0


@dataclass
class Page:
    """Elements in page order; runs are (element, text) in page order."""

    tags: list[str] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    #: WEAK or STRONG where a mark names boilerplate, else 0.
    boiler: list[int] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    #: Text, or None for the begin or end of a block or a line break.
    runs: list[tuple[int, str | None, bool]] = field(default_factory=list)

    def add(self, tag: str, label: str, parent: int, boiler: int, main: bool = False) -> int:
        self.tags.append(tag)
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append([])
        self.boiler.append(boiler)
        self.main.append(main)
        if parent >= 0:
            self.children[parent].append(len(self.tags) - 1)
        return len(self.tags) - 1


def parse(source: str | None) -> Page:
    """A page's elements and text runs, with the standard's implied end tags."""
    page, text = Page(), source or ""
    open_ = [page.add("#root", "#root", -1, 0)]
    at = 0
    lower = None

    def words(run: str) -> None:
        if run and not run.isspace():
            page.runs.append((open_[-1], run, False))
        elif run:
            page.runs.append((open_[-1], " ", False))

    def close(depth: int) -> None:
        while len(open_) > depth:
            gone = open_.pop()
            if page.tags[gone] in BLOCK:
                page.runs.append((gone, None, True))

    while found := _TOKEN.search(text, at):
        if found.start() > at:
            words(text[at : found.start()])
        at = found.end()
        name = found[2]
        if not name:
            continue
        name = name.lower()
        if found[1]:
            for depth in range(len(open_) - 1, 0, -1):
                if page.tags[open_[depth]] == name:
                    close(depth)
                    break
                if name not in BLOCK and page.tags[open_[depth]] in BLOCK:
                    break  # a stray end tag of a phrase does not close blocks
            continue
        if name in ENDS_P or name in SIBLINGS:
            rivals = SIBLINGS.get(name, ("p",))
            for depth in range(len(open_) - 1, 0, -1):
                tag = page.tags[open_[depth]]
                if tag in rivals:
                    close(depth)
                    break
                if tag in SCOPES and tag not in rivals:
                    break
        marked = marks(found[3])
        boiler = _boiler(name, marked)
        shown = [marked.get("class", ""), marked.get("role", ""), "" if name in PROSE else marked.get("id", "")] if marked else []
        label = _DIGITS.sub("0", ".".join([name, *(x.strip().lower() for x in shown if x)]))
        if name == "br" or name == "hr":
            page.runs.append((open_[-1], " " if name == "br" else None, name == "hr"))
            continue
        here = page.add(name, label, open_[-1], boiler, name == "main" or marked.get("role", "").strip().lower() == "main")
        if name in VOID:
            continue
        if name in RAW:
            lower = lower if lower is not None else text.lower()
            end = lower.find(f"</{name}", at)
            if end < 0:
                break
            at = text.find(">", end)
            at = len(text) if at < 0 else at + 1
            continue
        if name in BLOCK:
            page.runs.append((here, None, True))
        open_.append(here)
    else:
        words(text[at:])
    close(1)
    return page


def own_texts(page: Page) -> tuple[list[int], list[int]]:
    """Hash of each element's own text, 0 without any, and its characters."""
    held: dict[int, list[str]] = {}
    for element, run, _ in page.runs:
        if run is not None and not run.isspace():
            held.setdefault(element, []).append(" ".join(run.split()))
    out, sizes = [0] * len(page.tags), [0] * len(page.tags)
    for element, runs in held.items():
        out[element] = hash(tuple(runs)) or 1
        sizes[element] = sum(map(len, runs))
    return out, sizes


class Aligner:
    """Simple tree matching, remembered by the shapes of both trees."""

    def __init__(self, limit: int = 200_000):
        self.shapes: dict[tuple, int] = {}
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.limit = limit

    def shape(self, page: Page) -> list[int]:
        """Number of each element's subtree shape; equal numbers mean equal shapes."""
        out = [0] * len(page.tags)
        for i in range(len(page.tags) - 1, -1, -1):
            key = (page.labels[i], *[out[c] for c in page.children[i]])
            if key not in self.shapes:
                self.shapes[key] = len(self.sizes)
                self.sizes.append(1 + sum(self.sizes[out[c]] for c in page.children[i]))
            out[i] = self.shapes[key]
        return out

    def align(self, a: Page, b: Page) -> list[int]:
        """For each element of b the matched element of a, or -1."""
        if len(self.known) > self.limit:
            self.__init__(self.limit)
        sa, sb = self.shape(a), self.shape(b)
        out = [-1] * len(b.tags)
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            out[j] = i
            ca, cb = a.children[i], b.children[j]
            stack += [(ca[x], cb[y]) for x, y in self._children(a, b, sa, sb, i, j)[1]]
        return out

    def _weight(self, a, b, sa, sb, i, j) -> int:
        if sa[i] == sb[j]:
            return self.sizes[sa[i]]
        if a.labels[i] != b.labels[j]:
            return 0
        return 1 + self._children(a, b, sa, sb, i, j)[0]

    def _children(self, a, b, sa, sb, i, j) -> tuple[int, list[tuple[int, int]]]:
        """Most nodes that the children of two elements can pair, and which pairs do."""
        key = (sa[i], sb[j])
        if key in self.known:
            return self.known[key]
        x, y = a.children[i], b.children[j]
        m, n = len(x), len(y)
        head = 0
        while head < m and head < n and sa[x[head]] == sb[y[head]]:
            head += 1
        tail = 0  # equal shapes at either end pair at no loss: no other partner weighs more
        while tail < m - head and tail < n - head and sa[x[m - 1 - tail]] == sb[y[n - 1 - tail]]:
            tail += 1
        pairs = [(k, k) for k in range(head)] + [(m - 1 - k, n - 1 - k) for k in range(tail)]
        total = sum(self.sizes[sa[x[k]]] for k, _ in pairs)
        rows, cols = range(head, m - tail), range(head, n - tail)
        if len(rows) and len(cols):
            best = np.zeros((len(rows) + 1, len(cols) + 1), dtype=np.int32)
            weights: dict[tuple[int, int], int] = {}
            for p, r in enumerate(rows, 1):
                line, above = [0], best[p - 1].tolist()
                for q, c in enumerate(cols, 1):
                    pair = (sa[x[r]], sb[y[c]])
                    if pair not in weights:
                        weights[pair] = self._weight(a, b, sa, sb, x[r], y[c])
                    line.append(max(above[q], line[-1], above[q - 1] + weights[pair] if weights[pair] else 0))
                best[p] = line
            p, q = len(rows), len(cols)
            total += int(best[p, q])
            while p and q:
                w = weights[(sa[x[rows[p - 1]]], sb[y[cols[q - 1]]])]
                if w and best[p, q] == best[p - 1, q - 1] + w:
                    pairs.append((rows[p - 1], cols[q - 1]))
                    p, q = p - 1, q - 1
                elif best[p, q] == best[p - 1, q]:
                    p -= 1
                else:
                    q -= 1
        self.known[key] = (total, pairs)
        return self.known[key]


def main_text(page: Page, template: set[int] | frozenset = frozenset()) -> str:
    """Blocks of the main part, joined by line breaks. template: the page's template elements."""
    n = len(page.tags)
    inside = [False] * n  # of an article or main part
    block = [0] * n  # the nearest block
    roots = {i for i, t in enumerate(page.tags) if t == "article" and page.boiler[i] != STRONG}
    roots = roots or {i for i in range(n) if page.main[i]}
    own = own_texts(page)[0] if template else []
    dropped = [0] * n
    for i in range(n):
        parent = page.parents[i]
        if parent >= 0:
            inside[i], dropped[i], block[i] = inside[parent], dropped[parent], block[parent]
        if page.tags[i] in BLOCK:
            block[i] = i
        if i in roots:
            inside[i] = True
            dropped[i] = STRONG if dropped[i] == STRONG else 0  # an id about an article does not unmake it
        mark = page.boiler[i]
        if mark == STRONG or page.tags[i] in NO_TEXT or page.tags[i] == "header" and not inside[i]:
            dropped[i] = STRONG
        elif mark and not inside[i]:
            dropped[i] = dropped[i] or WEAK

    def constant(element: int) -> bool:
        """Whether a template element's text goes."""
        if not inside[element]:
            return True
        if page.tags[element] in TITLES:
            return False
        around = block[element]
        return around == element or around in template or not own[around]

    # blocks as (text, title that is template, whether template text went here)
    blocks, line, title, gone = [], [], True, False

    def end():
        nonlocal line, title, gone
        text = " ".join("".join(line).split())
        if text or gone:
            blocks.append((text, bool(text) and title))
        line, title, gone = [], True, False

    for element, run, breaks in page.runs:
        if breaks:
            end()
        elif not dropped[element] and (inside[element] or not roots):
            if element in template and constant(element):
                gone = gone or not run.isspace()
                continue
            if not run.isspace():
                title = title and element in template and page.tags[element] in HEADINGS
            line.append(entities.unescape(run) if "&" in run else run)
    end()
    # a constant heading goes with the constant text that it introduces
    out, follows_gone = [], False
    for text, is_title in reversed(blocks):
        if not text:
            follows_gone = True
        elif not (is_title and follows_gone):
            out.append(text)
            follows_gone = follows_gone and is_title
    return "\n".join(reversed(out))


class _Kept(OrderedDict):
    """The parsed references of the last sites."""

    def page(self, source: str) -> tuple[Page, list[int], tuple[int, ...]]:
        if source not in self:
            if len(self) >= 256:
                self.popitem(last=False)
            page = parse(source)
            texts = own_texts(page)[0]
            self[source] = (page, texts, headings(page, texts))
        self.move_to_end(source)
        return self[source]


def headings(page: Page, texts: list[int]) -> tuple[int, ...]:
    return tuple(x for t, x in zip(page.tags, texts, strict=True) if x and t in HEADINGS)


def references(pages: DataFrame) -> DataFrame:
    """One page of each site: (site, reference), the one nearest to the median length."""
    sizes = pages.where("site is not null and html is not null").select("site", F.length("html").alias("n"), F.xxhash64("html").alias("page"))
    middle, _ = durable(sizes.groupBy("site").agg(F.percentile_approx("n", 0.5, 1000).alias("middle")), "html-middles")
    near = spread_join(sizes, middle, "site", 128, "inner")
    near = near.groupBy("site").agg(F.min(F.struct(F.abs(F.col("n") - F.col("middle")).alias("off"), "page")).alias("pick"))
    picked, _ = durable(near.select("site", F.col("pick.page").alias("picked")), "html-picks")
    found = spread_join(pages.select("site", "html"), picked, "site", 128, "inner").where(F.xxhash64("html") == F.col("picked"))
    return durable(found.groupBy("site").agg(F.min("html").alias("reference")), "html-references")[0]


def templates(pages: DataFrame, known: DataFrame, min_pages: int = MIN_PAGES, same_share: float = SAME_SHARE) -> DataFrame:
    """Template elements of each site: (site, reference, template array<int>)."""

    def count(batches):
        aligner, kept, sums = Aligner(), _Kept(), {}

        def emptied():
            rows = [(h, list(range(len(m))), m.tolist(), s.tolist()) for h, (m, s) in sums.items()]
            sums.clear()
            return pd.DataFrame(rows, columns=["site", "element", "matched", "same"])

        for batch in batches:
            for site, source, reference in zip(batch["site"], batch["html"], batch["reference"], strict=True):
                if source == reference:
                    continue
                ref, ref_texts, ref_headings = kept.page(reference)
                page = parse(source)
                texts, sizes = own_texts(page)
                pairs = [(i, j) for j, i in enumerate(aligner.align(ref, page)) if i >= 0 and ref_texts[i]]
                if headings(page, texts) == ref_headings:
                    common = sum(sizes[j] for i, j in pairs if ref_texts[i] == texts[j])
                    if common >= (COPY_SHARE if ref_headings else BARE_COPY_SHARE) * sum(sizes):
                        continue
                matched, same = sums.setdefault(site, (np.zeros(len(ref.tags), np.int64), np.zeros(len(ref.tags), np.int64)))
                for i, j in pairs:
                    matched[i] += 1
                    same[i] += ref_texts[i] == texts[j]
            if len(sums) > 2_000:
                yield emptied()
        yield emptied()

    joined = spread_join(pages.where("html is not null").select("site", "html"), known, "site", F.octet_length("reference") + 64, "inner")
    counted = joined.select("site", "html", "reference").mapInPandas(count, "site string, element array<int>, matched array<long>, same array<long>")
    counted = counted.select("site", F.explode(F.arrays_zip("element", "matched", "same")).alias("c"))
    summed = counted.groupBy("site", "c.element").agg(F.sum("c.matched").alias("matched"), F.sum("c.same").alias("same"))
    constant = summed.where((F.col("matched") >= min_pages) & (F.col("same") >= same_share * F.col("matched")))
    flags = constant.groupBy("site").agg(F.sort_array(F.collect_list("element")).alias("template"))
    return durable(known.join(flags, "site"), "html-templates")[0]


_CLASSES = r"(?i)<(?:body|main|article|section|div|header|footer|table)\b[^<>]*?\bclass\s*=\s*[\"']?([^\"'<>]*)"


def sites(rows: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Add each row's site, from its host and html: the host and its layout, or the host alone for rare layouts."""
    classes = F.transform(F.regexp_extract_all("html", F.lit(_CLASSES), F.lit(1)), lambda c: F.regexp_replace(F.lower(c), r"\d+", "0"))
    layout = F.hex(F.xxhash64(F.array_join(F.array_sort(F.array_distinct(classes)), "|")))
    marked = rows.withColumn("layout", F.when(F.col("html").isNotNull(), F.concat_ws(" ", "host", layout)))
    marked = marked.withColumn("layout", F.when(F.col("host").isNotNull(), F.col("layout")))
    counts = marked.where("layout is not null").groupBy("layout").agg(F.count("*").alias("n")).where(F.col("n") >= 2 * min_pages)
    frequent, _ = durable(counts.select("layout", F.lit(True).alias("frequent")), "html-layouts")
    found = spread_join(marked, frequent, "layout", 128)
    return found.withColumn("site", F.when(F.col("frequent"), F.col("layout")).otherwise(F.col("host"))).drop("layout", "frequent", "host")


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, same_share: float = SAME_SHARE) -> DataFrame:
    """Every row with its main text: (row, text); row is a struct of the caller's columns but the html."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = bounded_batches(pages).select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html]).alias("row"), F.when(host != "", host).alias("host"), F.col(html).cast("string").alias("html")
    )
    rows = sites(rows, min_pages)
    plain = rows.select("site", "html")
    found = templates(plain, references(plain), min_pages, same_share)

    @F.pandas_udf("string")
    def read(sources: pd.Series, refs: pd.Series, flags: pd.Series) -> pd.Series:
        aligner, kept, out = Aligner(), _Kept(), []
        for source, reference, flag in zip(sources, refs, flags, strict=True):
            page, constant = parse(source), frozenset()
            if reference is not None and flag is not None and len(flag):
                ref, ref_texts, _ = kept.page(reference)
                marked, texts = set(flag), own_texts(page)[0]
                pairs = enumerate(aligner.align(ref, page))
                constant = frozenset(j for j, i in pairs if i in marked and texts[j] == ref_texts[i])
            out.append(main_text(page, constant))
        return pd.Series(out, dtype=object)

    joined = spread_join(rows, found, "site", F.octet_length("reference") + 64)
    return joined.select("row", read("html", "reference", "template").alias("text"))
