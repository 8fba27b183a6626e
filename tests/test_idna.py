"""International host names against Python's own Punycode."""

import random

from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions.idna import ascii_host
from pagemill.functions.urls import normalize_url, url_parts
from pagemill.operators.guard import guard_error
from pagemill.operators.links import host_link_counts

# Names of the Punycode paper and of everyday use.
KNOWN = {
    "bücher.example": "xn--bcher-kva.example",
    "faß.de": "xn--fa-hia.de",
    "пример.испытание": "xn--e1afmkfd.xn--80akhbyknj4f",
    "例え。テスト": "xn--r8jz45g.xn--zckzah",
    "ｅｘａｍｐｌｅ．com": "example.com",
    "so­ft.org": "soft.org",
    "xn--bcher-kva.example": "xn--bcher-kva.example",
    "ü" * 60 + ".org": "ü" * 60 + ".org",
    "plain.example": "plain.example",
    "": "",
}


def test_known_names(spark):
    rows = spark.createDataFrame([(h,) for h in [*KNOWN, None]], "host string")
    got = {r["host"]: r["out"] for r in rows.select("host", ascii_host(F.col("host")).alias("out")).collect()}
    assert got == {**KNOWN, None: None}


def test_labels_as_python_writes_them(spark):
    draw = random.Random(7)
    alphabets = ("abc-é", "äöüß", "абвгд", "漢字仮名a", "\U0001f600\U0001f601z", "aā一\U0001f600\U000e0100é")
    labels = {"".join(draw.choices(draw.choice(alphabets), k=draw.randint(1, 59))) for _ in range(600)}
    labels = sorted(x for x in labels if not x.isascii())
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r[0]: r[1] for r in rows.select("label", ascii_host(F.col("label"))).collect()}
    assert got == {x: "xn--" + x.encode("punycode").decode() for x in labels}


def test_one_host_however_it_is_written(spark):
    urls = ["http://BÜCHER.example/a", "http://b%C3%BCcher.example/a", "http://xn--bcher-kva.example/a", "http://bücher。example:80/a"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0] for r in rows.select(normalize_url(F.col("url"))).collect()} == {"http://xn--bcher-kva.example/a"}
    pages = [
        (1, "http://bücher.example/", "<a href='http://xn--bcher-kva.example/x'>x</a><a href='http://other.example/'>o</a>"),
        (2, "http://xn--bcher-kva.example/", "<a href='http://Bücher.example/x'>x</a><a href='/x'>y</a>"),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    links = {r["page_id"]: [x["url"] for x in r["links"]] for r in api.page_links(pages).select("page_id", "links").collect()}
    assert {u for found in links.values() for u in found} == {"http://xn--bcher-kva.example/x"} and set(links) == {1, 2}
    counted = host_link_counts(pages).collect()
    assert [(r["host"], r["target"], r["n_pages"]) for r in counted] == [("xn--bcher-kva.example", "/x", 2)]


def test_private_addresses_in_other_digits(spark):
    urls = ["http://１２７.0.0.1/", "http://①②⑦。⓪.0.1/", "http://𝟙𝟚𝟟.0.0.1/", "http://10​.0.0.1/", "http://１0.0.0.1:80/x"]
    rows = spark.createDataFrame([(u,) for u in urls], "url string")
    hosts = [r[0] for r in rows.select(url_parts(F.col("url"))["host"]).collect()]
    assert hosts == ["127.0.0.1", "127.0.0.1", "127.0.0.1", "10.0.0.1", "10.0.0.1"]
    assert all(r[0] for r in rows.select(guard_error(F.col("url"))).collect())
