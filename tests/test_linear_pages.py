"""Malformed pages cost time in proportion to their size."""

import time

from pyspark.sql import functions as F

from pagemill.functions.markup import kind_of, plain_text, tag_of, tokens_of
from pagemill.operators.links import anchors, page_links
from pagemill.operators.markdown import to_markdown

PIECES = {
    "open_tags": "<a ",
    "open_others": "<b ",
    "quoted_ends": """<a '>' """,
    "open_quotes": """<a href="x """,
    "anchors_with_open_tags": "<a href='/x'>y<b ",
    "declarations": "<!x ",
    "comments": "<!--",
    "scripts": "<script ",
    "open_scripts": "<script>",
    "titles": "<title x",
    "angles": "<",
    "breaks": "<br>",
    "pre_spaces": " ",
    "references": "&am",
    "end_tags": "</a ",
}
ENDS = {"quoted_ends": '"', "breaks": "x", "pre_spaces": "x</pre>"}
STARTS = {"breaks": "<p>x", "pre_spaces": "<pre>x"}


def page(name, size):
    piece = PIECES[name]
    return STARTS.get(name, "<p>text <a href='/q'>link</a> ") + piece * (size // len(piece)) + ENDS.get(name, "")


def seconds(job):
    begin = time.perf_counter()
    job()
    return time.perf_counter() - begin


def test_eight_times_the_page_eight_times_the_time(spark):
    """Square growth in one of the pages would make the larger ones cost 64 times as much, hours at 1 MB."""

    def run(size):
        rows = [(i, "http://h.example/", page(name, size)) for i, name in enumerate(PIECES)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        links = page_links(df).selectExpr("size(links)")
        text = to_markdown(df).selectExpr("length(markdown)")
        return lambda: (links.collect(), text.collect())

    small, large = run(125_000), run(1_000_000)
    small()
    took = min(seconds(small) for _ in range(2))
    assert seconds(large) < 24 * took


def test_tokens_of_malformed_pages(spark):
    cases = {
        "a<b c": ["a", "<b c"],
        "<p>x<a href='/y": ["<p>", "x", "<a href='/y"],
        "<a title='>'>x</a>": ["<a title='>'>", "x", "</a>"],
        "<a t='>' u=\">x</a>": ["<a t='>' u=\">", "x", "</a>"],
        "it's < 3 <3 <é": ["it's ", "<", " 3 ", "<", "3 ", "<", "é"],
        "<!doctype x": ["<!doctype x"],
        "<!-- a <b> -->c<!-- d": ["<!-- a <b> -->", "c", "<!-- d"],
        "<script>a<b></script><style>x": ["<script>a<b></script>", "<style>x"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "html string")
    got = {r.html: r.t for r in df.select("html", tokens_of(F.col("html")).alias("t")).collect()}
    assert got == cases
    assert all("".join(v) == k for k, v in got.items())


def test_a_tag_left_open_is_no_element(spark):
    df = spark.createDataFrame([("x <a href='/y' >z</a> <a href='/open",)], "html string")
    row = df.select(
        anchors(F.col("html")).alias("a"), plain_text(F.col("html")).alias("t"),
        F.transform(tokens_of(F.col("html")), lambda t: kind_of(t, tag_of(t))).alias("k"),
    ).first()
    assert [(a.href, a.text) for a in row.a] == [("/y", "z")]
    assert row.t == "x z "
    assert row.k == ["text", "open", "text", "close", "text", "drop"]
