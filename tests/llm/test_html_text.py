import time
from html.parser import HTMLParser

import pytest

from strata.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>Head &amp; title</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this great thing now and be happy for ever.</div><div class="notice">We use cookies.</div>
<article><h1>A  heading</h1><p><b>First &lt;para&gt; &copy; with <a href="x">a link</a>.<br><p>Second
 para.</p><div class="comments"><p>I like this article a lot and want everyone to know.</p></div><form><p>Name</p><input></form><p>Last one</p></article>
<aside><p>Some other story that has quite a few words in it too.</p></aside><footer>&copy; Somebody &middot; more words here for all.</footer></body></html>"""


def test_page():
    assert h.main_text(PAGE) == "A heading\nFirst <para> © with a link.\nSecond para.\nLast one"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("plain words", "plain words"), ("<article>cut <b>short", "cut short"), ("<script>never closed <p>x", ""),
        ("<!-- never closed <p>x", ""), ("<article><p>a&nbsp;b　c</article>", "a b c"), ("<article><p>one</p><p>&#x41;&#66;&eacute;</p>", "one\nABé"),
        ('<article><p title="a > b">x</p>', "x"), ("<nav>only menu</nav>", ""), ("<article>1 < 2 and 3 > 2</article>", "1 < 2 and 3 > 2"),
        ('<article><p title="never closed>a</p><p>b', "a\nb"), ("<article><p title=it's>don't</p><p>it's", "don't\nit's"), ("<article><p a='>' b>x</article>", "x"),
        ("<article>x<br/>y<hr>z<script/>no</script>w", "x\ny\nzw"), ("<article>" + "<b " * 3000, ""),
    ],
)
def test_pages(page, want):
    assert h.main_text(page) == want


def test_long_page_is_whole():
    body = "".join(f"<p>paragraph number {i} of many</p>" for i in range(20000))
    text = h.main_text(f"<nav><a>x</a></nav><article>{body}</article><footer>no</footer>")
    assert text.count("\n") == 19999 and text.endswith("19999 of many")


def test_names():
    page = """<div class="site-header">Site</div><div id="post-content"><div class="post-header"><h1>Title</h1></div><p class="overflow-hidden" data-id="ads">Kept text</p>
<div hidden>no</div><div style="display:none">no</div><section class="comment-list"><article class="comment"><p>no</p></article></section></div><div class="ad-slot">no</div>"""
    assert h.main_text(page) == "Title\nKept text"


def test_without_an_article():
    words = " ".join(f"word{i}" for i in range(60))
    page = f'<div><a href="x">Home</a></div><div><p>{words}</p><p>{words}</p></div><div class="footer">All rights</div>'
    assert h.main_text(page) == f"{words}\n{words}"


def test_words_and_links_of_blocks_and_neighbours_decide():
    used = set()

    def walk(node):
        if isinstance(node, h.Node):
            used.add(h.FEATURES[node.feature])
            walk(node.below), walk(node.above)

    walk(h.tree())
    assert {"words", "links"} <= used and used & {"words_before", "words_after"} and used & {"links_before", "links_after"}


def test_comments_in_article_elements_are_not_the_article():
    words = " ".join(f"word{i}" for i in range(40))
    page = f'<div class="content"><p>{words}</p><p>{words}</p></div><article class="comment"><p>I like it</p></article><article class="comment"><p>{words} no</p></article>'
    assert h.main_text(page) == f"{words}\n{words}"


@pytest.mark.parametrize(("name", "hidden", "kept"), [("related", "", True), ("notice", "", True), ("comments", "", False), ("ad", "", False), ("notice", " hidden", False)])
def test_long_text_in_named_sections(name, hidden, kept):
    words = " ".join(f"word{i}" for i in range(50))
    links = "".join("<li><a href='/x'>one more of them</a></li>" for _ in range(4))
    page = f'<article><p>{words}</p><div class="{name}"{hidden}><p>{words} own</p><p>short</p></div><p>{words}</p><div class="share"><ul>{links}</ul></div></article>'
    want = [words, words]
    assert h.main_text(page) == "\n".join(want)  # its neighbours are short
    page = page.replace("<p>short</p>", "")
    assert h.main_text(page) == "\n".join([words, f"{words} own", words] if kept else want)


def test_lists_of_links():
    words = " ".join(f"word{i}" for i in range(50))
    links = "".join("<li><a href='/x'>one more of them</a></li>" for _ in range(5))
    link = "<p><a href='/x'>a link</a></p>"
    assert h.main_text(f"<article><p>{words}</p>{link}<p>{words}</p></article>") == f"{words}\na link\n{words}"
    assert "of them\none" not in h.main_text(f"<article><p>{words}</p><ul>{links}</ul></article>")
    assert h.main_text(f"<div><ul>{links}<li>Menu</li>{links}</ul><p>{words}</p></div>") == words


@pytest.mark.parametrize(
    "page",
    [
        '<article class="post comments-open">{}</article>', '<div class="site has-sidebar"><article>{}</article></div>', '<main class="search-page">{}</main>',
        '<article><section class="related-work">{}</section></article>', '<article><div class="share-price-table">{}</div></article>', '<form id="aspnetForm"><article>{}</article></form>',
        '<div class="widget"><article>{}</article></div>', '<main class="search">{}</main>', '<div id="no-ads"><article class="no-comments">{}</article></div>',
    ],
)
def test_names_that_only_begin_like_a_region(page):
    words = " ".join(f"word{i}" for i in range(40))
    assert h.main_text(page.format(f"<h1>Title</h1><p>{words}</p><p>end</p>")) == f"Title\n{words}\nend"


@pytest.mark.parametrize("name", ["comment-list", "commentsArea", "ad_slot", "banner-ad", "cookie-banner", "site-footer__nav", "sidebar-left", "share-buttons", "widget_text", "main-nav", "related-posts"])
def test_names_of_regions(name):
    page = f'<div class="{name}"><article><p>A card with a few words.</p></article></div><article><p>The text of the page itself.</p><div class="x {name}"><p>no</p></div></article>'
    assert h.main_text(page) == "The text of the page itself."


def test_deep_nesting_takes_linear_time():
    n = 60_000
    began = time.time()
    assert h.main_text("<div>" * n + "text here</p></ul></section>" * n + "</div>" * n).count("\n") == n - 1
    assert time.time() - began < 30


def test_query(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = h.extract(pages).collect()
    assert len(out) == 4 and {(r["page_id"], r["n_chars"]) for r in out} == {(1, len(h.main_text(PAGE))), (2, 0), (None, 0)}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert h.extract(pages.where("false")).count() == 0


class Reader(HTMLParser):
    """Blocks by the standard library's parser: what is between two block tags, without hidden elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.text, self.raw = [], [], 0

    def cut(self):
        text = " ".join("".join(self.text).split())
        self.found += [text] if text else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title", "noscript", "template", "svg", "iframe", "textarea", "select", "object"):
            self.raw += 1
        elif tag in h.BLOCK:
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title", "noscript", "template", "svg", "iframe", "textarea", "select", "object"):
            self.raw -= 1
        elif tag in h.BLOCK:
            self.cut()

    def handle_data(self, data):
        self.text += [data] if not self.raw else []


def test_blocks_by_another_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    for page in [PAGE, *pages]:
        reader = Reader()
        reader.feed(page)
        reader.close()
        reader.cut()
        assert [t for t, *_ in h.blocks(page)] == reader.found


def test_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "own", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert h.extract(pages).columns == ["page_id", "url", "text", "n_chars"] and h.extract(pages).head()["text"] == h.main_text(PAGE)
