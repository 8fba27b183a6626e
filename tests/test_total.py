"""No page or URL may end the job: value functions answer for any input."""

import html
import random

from pyspark.sql import functions as F

from pagemill.functions.addresses import canonical_ipv4, is_private_ipv6, parse_cidr
from pagemill.functions.text import decode_entities
from pagemill.functions.urls import url_parts


def spelled(rng, alphabet, most):
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(1, most)))


def test_number_references_of_any_length(spark):
    rng = random.Random(7)
    hexes = [spelled(rng, "0123456789abcdefABCDEF", 30) for _ in range(300)]
    decs = [spelled(rng, "0123456789", 30) for _ in range(300)] + ["0" * 40 + "65", "1114111", "1114112"]
    texts = [f"a&#x{h};b" for h in hexes] + [f"a&#{d};b" for d in decs]

    def want(n):
        if not 0 < n <= 0x10FFFF or 0xD800 <= n <= 0xDFFF:
            return "�"
        return html.unescape(f"&#{n};") if 0x80 <= n <= 0x9F else chr(n)

    expected = [f"a{want(int(h, 16))}b" for h in hexes] + [f"a{want(int(d))}b" for d in decs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decode_entities(F.col("t")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    wrong = [(t, got[i], e) for i, (t, e) in enumerate(zip(texts, expected, strict=True)) if got[i] != e and e[1] not in "\x81\x8d\x8f\x90\x9d"]
    assert not wrong, wrong[:5]


def test_every_standard_name(spark):
    from html.entities import html5

    names = [n for n in html5 if "\n" not in html5[n]]
    texts = [f"x &{n} y" for n in names] + ["&copyfoo &notit; &amp &ampx &unknown; &;", "&" + "z" * 5000 + ";"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decode_entities(F.col("t")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    wrong = [(t, got[i]) for i, t in enumerate(texts) if got[i] != html.unescape(t)]
    assert not wrong, wrong[:5]


def test_old_names_in_attributes(spark):
    cases = {"?a=1&copy=2": "?a=1&copy=2", "?a&copyx": "?a&copyx", "a &copy": "a ©", "&lt;&amp;x": "<&x", "&copy.": "©."}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = df.select("t", decode_entities(F.col("t"), in_attribute=True).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


def test_address_parts_of_any_length(spark):
    rng = random.Random(3)

    def part():
        kind = rng.randint(0, 2)
        body = spelled(rng, "0123456789abcdef" if kind == 0 else "01234567", 40)
        return ("0x" if kind == 0 else "0" if kind == 1 else "") + body

    def value(p):
        if p.startswith("0x"):
            return int(p[2:] or "0", 16)
        if len(p) > 1 and p[0] == "0":
            return int(p, 8) if all(c in "01234567" for c in p) else None
        return int(p) if p.isdigit() else None

    def want(host):
        values = [value(p) for p in host.split(".")]
        if len(values) > 4 or None in values or any(v > 255 for v in values[:-1]) or values[-1] >= 256 ** (5 - len(values)):
            return None
        n = sum(v << 8 * (3 - i) for i, v in enumerate(values[:-1])) + values[-1]
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))

    hosts = [".".join(part() for _ in range(rng.randint(1, 4))) for _ in range(400)]
    hosts += ["0x" + "0" * 60 + "7f.1", "0" * 80 + "177.1", "0xfffffffffffffffffffff", "07777777777777777777777777777", "1.2.3.0x", "0x"]
    df = spark.createDataFrame(list(enumerate(hosts)), "i int, h string")
    got = {r.i: r.q for r in df.select("i", canonical_ipv4(F.col("h")).alias("q")).collect()}
    wrong = [(h, got[i], want(h)) for i, h in enumerate(hosts) if got[i] != want(h)]
    assert not wrong, wrong[:5]
    urls = df.select(F.concat(F.lit("http://"), "h", F.lit("/")).alias("u"))
    assert urls.select(url_parts(F.col("u")).alias("p")).where("p.host IS NOT NULL OR true").count() == len(hosts)
    odd = spark.createDataFrame([("::ffff:ffff:ffff",), ("::ffff:fffff:1",), ("9" * 400,), ("10.0.0.0/" + "9" * 50,)], "a string")
    odd.select(is_private_ipv6(F.col("a")).alias("p"), parse_cidr(F.col("a")).alias("c")).collect()
