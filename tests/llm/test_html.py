import html as stdlib
import re
import time

from pyspark.sql import types as T

from loomq.llm import queries
from loomq.llm.html import Page, main_texts

CHROME = '<nav><ul><li><a href="/a">A</a></li></ul></nav><!-- x --><div class="ad big">Buy</div>'


def test_rules():
    page = f"""<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>";</script></head>
    <body class="has-sidebar"><header>Site</header>{CHROME}<div class="wrap sidebar"><article class="post"><header><h1>Head &amp;amp; &eacute;</h1></header>
    <p><b>One  two.<br><p>Thr<i>ee</i>&nbsp;x < y</p><form>f<input></form><div id="cookie-notice">n</div><ul><li>l1<li>l2</ul>
    <aside>s</aside><div role="navigation">r</div><div>plain<span>er</span></div><section class="comments"><p>reader</p></section><footer>by</footer></article></div>
    <article class="comment">reader too</article><div class="sidebar">side</div><footer>&copy; x</footer>"""
    assert Page(page).text() == "Head &amp; é\nOne two.\nThree x < y\nl1\nl2\nplainer"


def test_odd_markup():
    for source, text in {
        "": "", "plain": "plain", "<p>a<p>b": "a\nb", "<article><p>a</p></div>b": "a\nb", "<p a='x>y'>q</p>": "q", '<p a="x>q</p>r': 'q r'.replace(" ", "\n"),
        "a<!-- b": "a", "<article>a<script>b": "a", "<main><p>m</p></main><p>o</p>": "m", "<td>a<td>b": "a\nb", "x &lt;p&gt; &am": "x <p> &am", "<p>" * 3 + "</p></b>c": "c",
        "<div>" * 5000 + "deep": "deep",
    }.items():
        assert Page(source).text() == text, source


def test_attributes():
    page = """<article><div class="post-header"><h1>T</h1></div><p>a <a href="/hidden/class=ad?id=ads">b</a> <i data-role="form" data-id="ad">c</i></p>
    <p hidden>no</p><p aria-hidden="true">no</p><p id=ad>no</p><p CLASS='x share'>no</p><p title="class='ad'">d</p><p class="shadow admin">e</p></article>"""
    assert Page(page).text() == "T\na b c\nd\ne"


def test_names():
    """A class or id drops no element for a word among others, nor one that holds most of the text."""
    for source, text in {
        '<body><div class="site no-sidebar"><p>a</p><p>b</p></div></body>': "a\nb",
        '<div id="page" class="has-sidebar"><p>a</p><div class="sidebar">s</div></div>': "a",
        '<div class="page left-sidebar"><p>long text</p><div class="left-sidebar">s</div></div>': "long text",
        '<article><p>a</p><div class="ad-free">b</div><section id="related-work"><p>c</p></section><div class="related-posts">d</div></article>': "a\nb\nc",
        '<div class="widget menu">chrome chrome</div><article><div class="widget"><p>whole</p></div></article>': "whole",
        '<article><p>a</p><div class="comments" id="comment-12">many more words of readers</div></article>': "a",
        '<p>a text</p><div class="site-footer">f</div><div id="ad-1" class="big">d</div>': "a text",
    }.items():
        assert Page(source).text() == text, source


def test_content_stays():
    """Ids made from titles, and class names of content, rule nothing out."""
    page = """<article><h2 id="related-work">Related work</h2><p>x</p><h2 id="search">Search</h2><p class="notice-period">y</p><figure class="banner">z</figure>
    <h3 class="ad">Ads</h3><ul id="comments"><li id="menu">l</li></ul><table id="sidebar"><tr><td>t</td></tr></table></article>"""
    assert Page(page).text() == "Related work\nx\nSearch\ny\nz\nAds\nt"


def test_stray_tags_take_linear_time():
    began = time.perf_counter()
    n = 70_000
    assert Page("<i>" * n + "</b>" * n + "<p>a" * n).text().count("a") == n
    assert Page("<b>" * n + "</i>" * n + "</div>" * n + "x").text() == "x"
    assert Page("<div>" * 20_000 + "<span>y</p></em>" * 20_000).text() == "y" + "y" * 19_999
    assert time.perf_counter() - began < 12


def test_unmarked_furniture(spark):
    """Hosts without articles and without telling names: what recurs goes, copies of a page do not count as pages."""
    top, side = "<div><a href='/'>Home</a> <a href='/b'>More</a></div>", "<ul><li><a href='/x'>Links</a></li></ul>"
    rows = [(i, f"http://a.org/{i}", f"<body>{top}<div><h1>Title {i}</h1><p>Own words {i}.</p></div>{side}</body>") for i in range(4)]
    rows += [(10 + i, f"http://b.org/{i}", "<body><div><p>The same page at five addresses.</p></div></body>") for i in range(5)]
    rows += [(20 + i, f"http://c.org/{i}", f"<article><div>Box</div><div><p>Own {i}</p></div></article>") for i in range(3)]
    got = {r.page_id: r.text for r in main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: f"Title {i}\nOwn words {i}." for i in range(4)} | {10 + i: "The same page at five addresses." for i in range(5)} | {20 + i: f"Own {i}" for i in range(3)}
    assert got == want


def test_names_by_host(spark):
    """The count by host decides on what a name alone does not."""
    aside = '<p class="ad-free">Read without adverts.</p>'
    rows = [(i, f"http://a.org/{i}", f'<div class="site no-sidebar">{aside}<p>Own {i}</p></div>') for i in range(12)]
    rows += [(100 + i, f"http://a.org/b{i}", f"<article>{aside}<p>Own {i}</p></article>") for i in range(12)]
    rows += [(200, "http://b.org", f"<article>{aside}<p>Own</p></article>")]
    got = {r.page_id: r.text for r in main_texts(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i + k: f"Own {i}" for i in range(12) for k in (0, 100)} | {200: "Read without adverts.\nOwn"}


def test_template(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType())])
    box = "<div><p>Shared box</p></div>"
    rows = [(i, f"http://u@Site.org:80/{i}", f"<body>{box}<p>Own {i}</p></body>", "x") for i in range(20)]
    rows += [(100 + i, "http://site.org/a", f"<article>{box}<p>Often said.</p><p>Own {i}</p></article>", "x") for i in range(20)]
    rows += [(200, "http://other.org", f"<body>{box}</body>", None), (201, None, None, None), (202, "no url", "", None), (None, None, f"<p>{box}", None)]
    got = {r.page_id: r.text for r in main_texts(spark, spark.createDataFrame(rows, schema), rows_a_part=7).collect()}
    want = {i: f"Own {i}" for i in range(20)} | {100 + i: f"Often said.\nOwn {i}" for i in range(20)} | {200: "Shared box", 201: "", 202: "", None: "Shared box"}
    assert got == want
    assert main_texts(spark, spark.createDataFrame([], schema)).count() == 0


def test_production_pages(spark):
    """Pages of the tables have one article of plain paragraphs, which a pattern can read."""
    sf = "/root/testdata/sf0.01"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(stdlib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(b for b in blocks if b)
    rows = queries.op2_html_text(spark, sf).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)
