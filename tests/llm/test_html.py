"""Main text against hand-made pages, and the test tables' articles."""

import html
import re

import pytest

from strandloom.llm import common
from strandloom.llm.html import Aligner, extract, main_text, parse


def text(source):
    return main_text(parse(source))


CASES = [
    (None, ""),
    ("", ""),
    ("plain", "plain"),
    ("<p>a &amp; b<p>c<br>d", "a & b\nc d"),
    ("<nav>menu</nav><article><h1>T</h1><p>x  \n y</p></article><footer>f</footer>", "T\nx y"),
    ("<header>h</header><main><header><h1>T</h1></header>t<div class='share-bar'>s</div><aside>a</aside></main>", "T\nt"),
    ("<article><p><b>a<br><p>b</p><script>var x='</p>'</script><form>f</form></article>tail", "a\nb"),
    ("<article>one<!-- c --> two<style>p{}</style></article><section class=comments><article>no</article></section>", "one two"),
    ("<article><ul><li>a<li>b</ul>c</article", "a\nb\nc"),
    ("<article><p>1 &lt; 2 &#233; &copy; &bogus;</p><p> \t </p></article>", "1 < 2 é © &bogus;"),
    ("<article><p>x</b></p></i>y</article>", "x\ny"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<div id='cookie-notice'>n</div><div class='ad'>n</div><p>t</p><div role=navigation>n</div>", "t"),
    ("<article><p title='a > b'>x</p><img alt=\"<p>\">y", "x\ny"),
    # values of other attributes are no marks
    ("<article><p><a href='/x?id=comments&role=search'>a</a> b<p data-id='reply' data-class=ad>c</article>", "a b\nc"),
    ("<div class='post' CLASS='ad'>a</div><p id=x title=\"class='ad'\">b", "a\nb"),
    # ids made from headings, and classes that hold other words too
    ("<article><h2 id='related-work'>A</h2><h2 id='search-algorithms'>B</h2><section id='social-history'>c</section><section id=search>d</section></article>", "A\nB\nc\nd"),
    ("<article><div class='social-history'>a</div><div class='notice-of-motion'>b</div><p class='footer-note'>c</article>", "a\nb\nc"),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be</article>", "Let x=2 be"),
    ("<article>t<section id=comments>n</section><div class='reader-comments'>n</div><ul class='related posts'><li>n</ul><div class='adSlot_12'>n</div></article>", "t"),
    ("<article>t<div role='navigation'>n</div><div class='cookie-notice'>n</div><p class='ad'>n</p><div class='comment-list'>n</div></article>", "t"),
    ("<body class='sidebar login'><div id='search-box'><p>n</div><div id='ads'><article>a</article></div>", "a"),
    ("<body class='has-sidebar'><div id='sidebar-left'>n</div><div id='main-menu'>n</div><p>t", "t"),
    ("<p>" + "word " * 50_000, ("word " * 50_000).strip()),
]


@pytest.mark.parametrize(("source", "want"), CASES)
def test_pages(source, want):
    assert text(source) == want


def brute_match(a, b, i, j):
    if a.labels[i] != b.labels[j]:
        return 0
    x, y = a.children[i], b.children[j]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(1, len(x) + 1):
        for q in range(1, len(y) + 1):
            best[p][q] = max(best[p - 1][q], best[p][q - 1], best[p - 1][q - 1] + brute_match(a, b, x[p - 1], y[q - 1]))
    return 1 + best[-1][-1]


def test_alignment_pairs_most_nodes():
    pages = [parse(s) for s in (
        "<div><p>a<p>b<ul><li>1<li>2</ul><p>c</div>", "<div><p>a<ul><li>1</ul><p>b<b>c</b></div><p>d", "<p>a<div><ul><li>1<li>2<li>3</ul></div>",
        "<div><div><p>a</div><p>b<p>c<p>d</div>",
    )]
    aligner = Aligner()
    for a in pages:
        for b in pages:
            pairs = aligner.align(a, b)
            assert sum(i >= 0 for i in pairs) == brute_match(a, b, 0, 0)
            assert all(a.labels[i] == b.labels[j] for j, i in enumerate(pairs) if i >= 0)


def test_template_is_induced(spark):
    page = "<body><div><span>Site of all</span></div><div><p>{0}</p><p>more {0}</p></div><div><em>Read on</em></div></body>"
    rows = [(i, f"https://www.x.org/{i}", page.format(f"text {i}"), 0) for i in range(12)]
    rows += [(100, "https://y.org/1", page.format("alone"), 0), (101, None, page.format("none"), 0), (102, "bad", None, 0), (102, "bad", None, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted((r["row"]["page_id"], r["text"]) for r in extract(df).collect())
    assert got[:12] == [(i, f"text {i}\nmore text {i}") for i in range(12)]
    assert got[12:14] == [(100, "Site of all\nalone\nmore alone\nRead on"), (101, "Site of all\nnone\nmore none\nRead on")]
    assert got[14:] == [(102, ""), (102, "")]


WORDS = "amber birch cedar delta ember fjord grove haven islet jetty knoll lagoon".split()


def varied(i, k):
    return " ".join(WORDS[(i * 7 + j * (i % 5 + 1) + k) % len(WORDS)] for j in range(9)) + f" {i}"


def texts(spark, pages, **options):
    rows = [(i, f"https://www.x.org/{i}", source) for i, source in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r["text"] for r in sorted(extract(df, **options).collect(), key=lambda r: r["row"]["page_id"])]


def bare(i):
    """A page without an article or a telling tag, class or id."""
    return (
        f"<body><div><span>Our site</span><div>Best read daily</div></div><div><h1>Title {i}</h1><p>{varied(i, 0)}</p><p>{varied(i, 1)}</p></div>"
        "<div><b>Write to us</b><p>All rights kept by us</p></div></body>"
    )


def noted(i):
    """An article with notices that all pages share, headings that are part of it, and constant phrases in it."""
    return (
        f"<body><article><h1>Title {i}</h1><div>Now on our new app</div><p><b>Facts:</b> {varied(i, 0)}</p><h2>Method</h2><p>{varied(i, 1)}</p>"
        "<h2>Stay in touch</h2><p><em>Get our letter</em></p><p>Terms apply to all</p></article></body>"
    )


def test_pages_without_article_come_through_the_template(spark):
    pages = [bare(i) for i in range(15)]
    want = [f"Title {i}\n{varied(i, 0)}\n{varied(i, 1)}" for i in range(15)]
    assert texts(spark, pages) == want
    emptied = texts(spark, pages, same_share=2.0)
    assert sum(a != b for a, b in zip(want, emptied, strict=True)) == 15 and emptied[0].startswith("Our site\nBest read daily\n")


def test_shared_notices_leave_articles(spark):
    pages = [noted(i) for i in range(15)]
    want = [f"Title {i}\nFacts: {varied(i, 0)}\nMethod\n{varied(i, 1)}" for i in range(15)]
    assert texts(spark, pages) == want
    assert sum(a != b for a, b in zip(want, texts(spark, pages, same_share=2.0), strict=True)) == 15


def test_few_pages_make_no_template(spark):
    assert texts(spark, [bare(i) for i in range(5)])[3].startswith("Our site\n")
    assert texts(spark, [bare(i) for i in range(5)], min_pages=3)[3].startswith("Title 3\n")


def test_near_copies_are_no_evidence(spark):
    """Copies that differ in a paragraph keep their text, beside two other pages of their host."""
    copy = lambda i: f"<article><h1>One story</h1><p>{varied(1, 1)}</p><p>{varied(2, 2)}</p><p>{varied(i, 3)}</p></article>"
    pages = [copy(i) for i in range(20)] + [f"<article><h1>Other {i}</h1><p>{varied(i, 5)}</p></article>" for i in range(3)]
    got = texts(spark, pages)
    assert got[:20] == [f"One story\n{varied(1, 1)}\n{varied(2, 2)}\n{varied(i, 3)}" for i in range(20)]


def test_each_layout_has_its_reference(spark, monkeypatch):
    """Two layouts of a host, with and without broadcasts."""
    other = lambda i: f"<body><div class='wide'><p>Hot news of the day</p></div><div class='tall c{i}'><h2>T{i}</h2><p>{varied(i, 4)}</p></div></body>"
    pages = [bare(i) if i % 3 else other(i) for i in range(45)]
    want = [f"Title {i}\n{varied(i, 0)}\n{varied(i, 1)}" if i % 3 else f"T{i}\n{varied(i, 4)}" for i in range(45)]
    assert texts(spark, pages) == want
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    assert texts(spark, pages) == want


def test_broken_markup_takes_linear_time(spark):
    """Openings without end, a hundred thousand times."""
    pages = ["<div " * 100_000, "<div class='" * 100_000, "<script " * 100_000 + "x", "<a '" * 100_001, "<!-- " * 100_000, "<p>" * 20_000 + "end"]
    assert texts(spark, pages)[-1] == "end"


def test_test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in extract(pages).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|<footer|$)", sources[r["row"]["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_empty_table(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
