import ipaddress
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions.addresses import parse_cidr
from pagemill.functions.markup import attribute, page_title, tokens_of
from pagemill.functions.text import decode_entities, flag_word
from pagemill.functions.urls import resolve_href, url_extension, url_issues, url_parts
from pagemill.operators import content, links

DOCX = content.DOCX


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.x for r in rows.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_content_types(spark):
    cases = {
        "text/html": "html",
        "text/html; charset=utf-8": "html",
        "application/xhtml+xml": "html",
        "application/pdf": "pdf",
        DOCX: "docx",
        "image/png": "unsupported",
        "application/json": "unsupported",
        "application/msword": "unsupported",
        None: "html",
    }
    assert column(spark, list(cases), content.classify) == list(cases.values())


def test_extensions(spark):
    urls = ["https://example.com/file.pdf", "https://example.com/file.pdf?token=abc", "https://example.com/download"]
    assert column(spark, urls, url_extension) == [".pdf", ".pdf", None]


def test_octet_streams(spark):
    rows = spark.createDataFrame(
        [
            ("http://h.org/octet-pdf", bytearray(bytes.fromhex("255044462d312e34"))),
            ("http://h.org/octet-unknown", bytearray(8)),
            ("http://h.org/file.pdf", bytearray()),
            ("http://h.org/file.docx", bytearray()),
        ],
        "url string, body binary",
    )
    kind = content.refined_type(F.lit(content.OCTETS), url_extension(F.col("url")), F.col("body"))
    got = [r.k for r in rows.select(kind.alias("k")).collect()]
    assert got == [content.PDF, content.OCTETS, content.PDF, DOCX]


def test_issues(spark):
    urls = ["http://example.com", "not-a-url", "file:///etc/passwd", None, "  ", "http://127.0.0.1/", "http://localhost/"]
    got = column(spark, urls, lambda c: url_issues(c)["rule"])
    assert got == [[], ["url"], ["url"], ["required"], ["required"], [], ["url"]]


def test_entities_against_standard_library(spark):
    import html

    texts = ["&lt;&amp;lt; &eacute;&nbsp;&#8364;&#x1F600;&rarr;", "plain", "&#128;&#150;", "&NotEqualTilde; &hellip; &frac12;"]
    assert column(spark, texts, decode_entities) == [html.unescape(t) for t in texts]
    assert column(spark, ["&nosuch; &"], decode_entities) == ["&nosuch; &"]


def test_flags(spark):
    assert column(spark, ["true", " 1 ", "TRUE", "0", None], flag_word) == [True, True, False, False, False]


def test_attributes_ignore_other_values(spark):
    tags = ["<a title='x href=\"no\"' HREF = /y>", "<a href>", "<a data-href=n>", '<a href="?a=1&copy=2&amp;b">']
    assert column(spark, tags, lambda c: attribute(c, "href")) == ["/y", "", None, "?a=1&copy=2&b"]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="<>/!-ab \"'=scripttle\n", max_size=60), min_size=20, max_size=60))
def test_tokens_rejoin(spark, texts):
    assert column(spark, texts, lambda c: F.array_join(tokens_of(c), "")) == texts


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**32 - 1), st.integers(0, 32)), min_size=30, max_size=60))
def test_cidr_agrees_with_ipaddress(spark, pairs):
    texts = [f"{ipaddress.ip_address(a)}/{b}" for a, b in pairs]
    want = [ipaddress.ip_network(t, strict=False) for t in texts]
    got = column(spark, texts, parse_cidr)
    assert [(g.lo, g.hi) for g in got] == [(int(w[0]), int(w[-1])) for w in want]


def test_resolve_agrees_with_urljoin(spark):
    rng = random.Random(7)
    base = "http://h.org/a/b/c?x=1"
    hrefs = ["".join(rng.choice(["a", "b/", "../", "./", "c.html", "?q=1", "/r/"]) for _ in range(4)) for _ in range(200)]
    hrefs = [h for h in hrefs if "//" not in h and "?" not in h[1:]]
    got = column(spark, hrefs, lambda c: resolve_href(url_parts(F.lit(base)), c))
    assert got == [urljoin(base, h) for h in hrefs]


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.open = True
            self.found.append([dict(attrs).get("href"), ""])

    def handle_endtag(self, tag):
        if tag == "a":
            self.open = False

    def handle_data(self, text):
        if self.open:
            self.found[-1][1] += text


def test_anchors_against_html_parser(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    for row in pages.select("html", links.anchors(F.col("html")).alias("a")).collect():
        parser = Anchors()
        parser.feed(row.html)
        assert [(x.href, x.text) for x in row.a] == [(h, t.strip()) for h, t in parser.found if h is not None]


def test_anchor_inside_script_inside_anchor(spark):
    html = "<a href=/1>one<script>x='<a href=/no>'</script> two<a href=/2><!-- <a href=/no> -->b"
    got = column(spark, [html], links.anchors)[0]
    assert [(x.href, x.text) for x in got] == [("/1", "one two"), ("/2", "b")]


def test_title(spark):
    pages = ["<script>'<title>no</title>'</script><title> A &amp; B </title><title>C</title>", "<p>x", "<title> </title>"]
    assert column(spark, pages, page_title) == ["A & B", None, None]
