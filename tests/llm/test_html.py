import numpy as np
import pytest

from assayer.llm import html
from assayer.llm.queries import op10_html_extraction

WORDS = " ".join(f"word{i}" for i in range(40))
CASES = [
    (None, ""),
    ("", ""),
    ("plain  text\n here", "plain text here"),
    (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a href='/'>home</a></nav><article><h1>Head &amp; tail</h1><p>{WORDS}<br>more</p><p>&lt;x&gt; 1 < 2&nbsp;ok</p></article><footer>&copy; us</footer></body></html>", f"Head & tail\n\n{WORDS} more\n\n<x> 1 < 2 ok"),
    (f'<div class="ad">{WORDS} {WORDS}</div><article><p>Short.</p></article><div id="comments">{WORDS}</div>', "Short."),
    (f"<body><div class='sidebar'>{WORDS}</div><div><p>{WORDS}</p><p>Two</p></div><form>{WORDS}</form><script>var a='<p>no</p>'</script>", f"{WORDS}\n\nTwo"),
    (f"<article><header><h1>T</h1></header><p>{WORDS}</p><aside>no</aside><div class=comment><p>{WORDS}</p></div></article>", f"T\n\n{WORDS}"),
    (f"<p>{WORDS}<p>unclosed <b>bold", f"{WORDS}\n\nunclosed bold"),
]


@pytest.mark.parametrize(("page", "want"), CASES)
def test_cases(page, want):
    assert html.extract(page, html.DEFAULT) == want


def test_region_against_all_stretches():
    rng = np.random.default_rng(0)
    for _ in range(200):
        x = rng.integers(-5, 6, rng.integers(1, 12)).astype(float)
        s, e = html.best_region(x)
        assert x[s:e].sum() == max(x[i:j].sum() for i in range(len(x)) for j in range(i + 1, len(x) + 1))


def test_table_keeps_articles_whole(spark, sf):
    """The pages' markup marks the article, so its own blocks are known without the operator."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside = self.inside or tag == "article"
            self.handle_endtag(tag)

        def handle_endtag(self, tag):
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        a = Article()
        a.feed((pages[r.page_id] or "").split("</article>")[0])
        a.close()
        assert r.text == "\n\n".join(b for x in a.blocks if (b := " ".join(x.split())))
        assert r.n_chars == len(r.text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x", 1.0), (1, None, None, "x", 1.0), (None, "u", f"<p>{WORDS}" * 4000, None, None)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars double")).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and len(got) == 3
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SOME = " ".join(f"more{i}" for i in range(30))
WRAPPED = [
    ('<p>one</p><svg class="i"/><p>two</p><p>three</p>', "one\n\ntwo\n\nthree"),
    ("<p>one</p><svg class='i' /><p>two</p><svg><text>no</text></svg><p>three</p>", "one\n\ntwo\n\nthree"),
    ("<p>one</p><svg viewBox='0 0'><text>no</text></svg><p>two</p>", "one\n\ntwo"),
    (f"<article><p>{WORDS} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p><math/><p>{SOME}</p></article>", f"{WORDS} x=2 end\n\n{SOME}"),
    (f"<body><div class='content has-sidebar'><p>{WORDS}</p><div class=sidebar>five words stand apart here</div><p>{SOME}</p></div></body>", f"{WORDS}\n\n{SOME}"),
    (f"<body><nav>{SOME}</nav><form action=x><div><p>{WORDS}</p><p>{SOME}</p></div></form></body>", f"{WORDS}\n\n{SOME}"),
    (f"<form><div class=has-menu><article><p>{WORDS}</p></article><div class=ad>{SOME}</div></div></form>", WORDS),
    (f"<div><p>{WORDS}</p><p>{SOME}</p></div><div id=comments><article><p>{SOME} {WORDS}</p></article></div>", f"{WORDS}\n\n{SOME}"),
    (f"<article><p>{WORDS}</p></article><div class=comments><article><p>{SOME}</p></article></div>", WORDS),
    (f"<article><p>{WORDS}</p><aside>open<p>{SOME}</article><p>{SOME}</p>", WORDS),
    (f"<article><p>{WORDS}</p><article id='div-comment-1' class='comment-body'><p>{SOME}</p><article>in it</article></article><p>{SOME}</p></article>", f"{WORDS}\n\n{SOME}"),
    (f"<article><p>{WORDS}</p></article><article class='comment'><p>{SOME} {SOME} {SOME}</p></article>", WORDS),
    (f"<div><p>{SOME}</p></div><div class=comments>{'<article class=comment><p>' + WORDS + '</p></article>'}</div>" * 1, SOME),
    (f"<article><p>{WORDS}</p></article><aside><article><p>{SOME}</p></article></aside>", WORDS),
    (f"<nav>{WORDS} {WORDS}</nav>", ""),
    ("<div class=cookie-banner>We use cookies</div>", ""),
]


@pytest.mark.parametrize(("page", "want"), WRAPPED)
def test_wrappers_and_embedded_elements(page, want):
    assert html.extract(page, html.DEFAULT) == want


PLAIN = [
    (f"<body><ul><li><a href=/a>home</a><li><a href=/b>news</a></ul><h1>Head</h1><p>{WORDS}</p><p>{SOME}</p><ul><li><a href=/c>next</a><li><a href=/d>last</a></ul></body>", f"Head\n\n{WORDS}\n\n{SOME}"),
    (f"<table><tr><td><a href=/>a</a></td><td><a href=/>b</a></td></tr></table><div>{WORDS}</div><div><b>{SOME}</b></div>", f"{WORDS}\n\n{SOME}"),
    (f"<div><a href=/>x</a><a href=/>y</a></div><blockquote>{WORDS}<pre>{SOME}</pre></blockquote><div><img src=x><input></div>", f"{WORDS}\n\n{SOME}"),
]


@pytest.mark.parametrize(("page", "want"), PLAIN)
def test_pages_without_article_markup(page, want):
    weights = html.DEFAULT | {"li": -3.0, "ul": -2.0, "td": -2.0, "tr": -2.0, "a": -2.0}
    assert html.extract(page, weights) == want
    start, end = html.best_region(html._scores(kept := html.tokens(page, weights), weights))
    assert 0 < start or end < len(kept)  # the region is a part of the page


@pytest.mark.parametrize("piece", ["<b ", "<b \"", "<b x='", "<!x", "<!--", "<script>", "</", "<svg ", "<b x=\"'", "=' ", "<?"])
def test_one_scan_over_broken_pages(piece):
    import time

    def took(n):
        began = time.process_time()
        html.extract(f"<p>{WORDS}</p>" + piece * n + ">", html.DEFAULT)
        html.extract(f"<p>{WORDS}</p>" + piece * n, html.DEFAULT)
        return time.process_time() - began

    assert took(200_000) < 10  # a scan anew from every sign would take hours


def test_quotes_that_nothing_closes():
    assert html.extract(f"<p title=it's>{WORDS}</p><p class=\"x>{SOME}</p>", html.DEFAULT) == f"{WORDS}\n\n{SOME}"
    assert html.extract(f"<p title='a > b'>{WORDS}</p>", html.DEFAULT) == WORDS


MENU = "<ul><li><a href=/a>first page</a><li><a href=/b>second page</a><li><a href=/c>third page</a></ul>"
INSIDE = [
    (f'<article><p>{WORDS}</p><p data-id="share-12">{SOME}</p></article>', f"{WORDS}\n\n{SOME}"),
    (f'<article><p>{WORDS}</p><section id="alert-fatigue">{SOME}</section><div class="social-history"><div class="widget-design">one</div></div></article>', f"{WORDS}\n\n{SOME}\n\none"),
    (f'<article><p>{WORDS}</p><div class="cookie-banner">{SOME}</div><div class="x share-buttons">{SOME}</div><div id=ad-slot-3>{SOME}</div></article>', WORDS),
    (f"<div>{SOME}</div><article><p>{WORDS}</p></article><div>{SOME}</div>", WORDS),
    (f"<article>{MENU}<h1>Head</h1><p>{WORDS}</p><ul><li>plain<li>points</ul>{MENU}</article>", f"Head\n\n{WORDS}\n\nplain\n\npoints"),
    (f"<article><h1>Head</h1><p>{WORDS}</p><p><a href=/o>read the original</a></p></article>", f"Head\n\n{WORDS}\n\nread the original"),
    (f"<article><p>{SOME}</p></article><div>ten words</div><article><p>{WORDS} {WORDS} {WORDS}</p></article>", f"{SOME}\n\n{WORDS} {WORDS} {WORDS}"),
    (f"<article><p>{SOME}</p></article><div><p>{WORDS} {WORDS}</p></div>", f"{SOME}\n\n{WORDS} {WORDS}"),
    (f"<article><p>teaser</p></article><div><p>{WORDS}</p></div>", f"teaser\n\n{WORDS}"),
]


@pytest.mark.parametrize(("page", "want"), INSIDE)
def test_articles_and_what_stands_in_them(page, want):
    weights = html.DEFAULT | {"li": -3.0, "ul": -3.0, "div": -2.0, "a": -2.0} if "<ul>" in page else html.DEFAULT
    assert html.extract(page, weights) == want


def test_pages_without_their_names(spark, sf):
    """With the article marked, adverts, menus and footers may be plain divisions; with their names, the article may be one."""
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights, whole = html.fit(pages), [r.html for r in pages.collect() if r.html]
    bare = [re.sub(r"<(/?)(nav|footer|header|aside)\b", r"<\1div", h.replace('class="ad"', 'class="q"')) for h in whole]
    plain = [re.sub(r"<(/?)article\b", r"<\1div", h) for h in whole]
    for page, a, b in zip(whole, bare, plain, strict=True):
        assert html.extract(a, weights) == html.extract(b, weights) == html.extract(page, weights)
        kept = html.tokens(a, weights)
        assert html.content(kept, weights)[:2] != (0, len(kept))  # the region is a part of the page
