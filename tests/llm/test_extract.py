import html
import re

import pytest

from curata.llm import extract
from curata.llm.queries import QUERIES

LONG = "This is a long paragraph of running text that says one thing after the other, with <b>bold</b> words and a <a href='/x'>link</a> in it."
PLAIN = re.sub("<[^>]*>", "", LONG)


def test_tree_fits_its_table():
    tree = extract.trained()
    wrong = 0
    for row in extract.LABELLED:
        node = tree
        while type(node) is tuple:
            node = node[2] if row[node[0]] <= node[1] else node[3]
        wrong += node != row[-1]
    assert wrong <= 3


def test_article_page():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t="</p><p>no</p>";</script></head><body class="post">
    <header><a href="/">Site</a> says hello to all of you who come by and read these lines today</header><nav><ul><li><a href="a">A</a></li></ul></nav>
    <!-- <p>no</p> --><div class="ad-box">Buy this now, it is a very good thing to buy and you will not regret it at all.</div>
    <article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Second&nbsp;one<br>next   line</p><div class="cookie-notice">We use cookies for all of these many things.</div>
    <form>Name <input name=x> please do write your name here to get our letter</form><aside>Read also this</aside><p>un<b>brok</b>en &lt;tag&gt;</p></article>
    <section id="comments"><p>{LONG}</p></section><footer>&copy; Site</footer></body></html>"""
    assert extract.main_text(page) == f"Title & more {PLAIN} Second one next line unbroken <tag>"


def test_page_without_names():
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><p>{LONG}</p><h2>Part two</h2><p>{LONG}</p></div><div><a href=3>More</a></div></body>"
    assert extract.main_text(page) == f"{PLAIN} Part two {PLAIN}"


@pytest.mark.parametrize("page", ["", "<", "<<<>>>", "<p", "<a href='", "<!-- open", "<script>open", "</div></p>", "&#xD800; &am &amp", "<p>" * 5000, "<a '" * 3000, "<b \"" * 3000])
def test_broken_pages(page):
    assert isinstance(extract.main_text(page), str)


def test_edge_rows(spark):
    rows = [(1, None, "u", 9), (2, "", None, 9), (None, f"<article><p>{LONG}</p></article>", "u", 9), (None, f"<article><p>{LONG}</p></article>", "u", 9), (4, f"<article>{'<p>' + LONG + '</p>'}</article>" * 3000, "v", 9)]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = sorted((r.n_chars, r.text[:4]) for r in extract.extract(pages).collect())
    assert got == [(0, ""), (0, ""), (len(PLAIN), "This"), (len(PLAIN), "This"), (3000 * (len(PLAIN) + 1) - 1, "This")]
    assert extract.extract(pages.limit(0)).count() == 0


def test_query_finds_the_articles(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op8_html_extraction"](spark, sf).collect():
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        inner = re.sub("</?b>", "", inner)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert r.text == want and r.n_chars == len(want)


def test_wrappers_do_not_hide_the_article():
    for before, after in (
        ("<div class='content no-sidebar'>", "</div>"),
        ("<article class='post comments-open category-legal'>", "</article>"),
        ("<form id=aspnetForm action='x'>", "</form>"),
        ("<div class='overflow-hidden'>", "</div>"),
        ("<div style='overflow:hidden'>", "</div>"),
        ("<div class='with-sidebar'><main>", "</main></div>"),
        ("<div class='sidebar'><main>", "</main></div>"),
        ("<form><article>", "</article></form>"),
    ):
        assert extract.main_text(f"<body>{before}<p>{LONG}</p><p>{LONG}</p>{after}</body>") == f"{PLAIN} {PLAIN}", before
    assert extract.main_text(f"<body><main><header><h1>The title</h1></header><p>{LONG}</p></main></body>") == f"The title {PLAIN}"
    for inner in ("<div hidden>", "<div style='color:red; display: none'>", "<section id=comments><article>", "<div class='comment-list'><article class='comment-body'>", "<aside><div class=content>"):
        assert extract.main_text(f"<body><article><p>{LONG}</p></article>{inner}<p>{LONG}</p></body>") == PLAIN, inner


def test_linked_adverts_and_short_lines():
    advert = "<div class='ad-box'><a href='x'>Buy this very good thing now</a></div>"
    assert extract.main_text(f"<article><p>{LONG}</p>{advert}<p>{LONG}</p></article>") == f"{PLAIN} {PLAIN}"
    lines = ["The sun went down behind the hill", "and all the birds were still", "a light came on across the bay", "and called the boats to stay"]
    poem = "".join(f"<p>{x}</p>" for x in lines)
    page = f"<body><div><a href=1>Home</a></div><div><a href=2>News</a></div><div><p>{LONG}</p>{poem}</div><div><a href=3>More</a></div></body>"
    assert extract.main_text(page) == " ".join([PLAIN, *lines])
