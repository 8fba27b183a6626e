"""Guard cases as data: url, allowed ranges, allowed hosts, blocked or not."""

import pytest
from pyspark.sql import functions as F

from pagemill.api import guard
from pagemill.operators.guard import INVALID, PRIVATE, address_verdicts, allow_hosts, guard_error

STORE = "pdf-store.internal.svc.cluster.local"
CASES = [
    ("http://10.0.0.1/secret", (), (), True),
    ("http://192.168.1.1/", (), (), True),
    ("http://127.0.0.1/admin", (), (), True),
    ("file:///etc/passwd", (), (), True),
    ("http://93.184.216.34/", (), (), False),
    ("http://10.96.0.1/", ("10.96.0.0/12",), (), False),
    ("http://10.111.255.254/", ("10.96.0.0/12",), (), False),
    ("http://10.0.0.1/", ("10.96.0.0/12",), (), True),
    ("http://10.100.0.1/", ("10.96.0.0/12", "192.168.1.0/24"), (), False),
    ("http://192.168.1.50/", ("10.96.0.0/12", "192.168.1.0/24"), (), False),
    ("http://192.168.2.1/", ("10.96.0.0/12", "192.168.1.0/24"), (), True),
    ("file:///etc/passwd", ("10.0.0.0/8",), (), True),
    ("http://10.96.0.1/", ("not-a-cidr", "10.96.0.0/12"), (), False),
    ("http://10.0.0.1/", ("not-a-cidr", "10.96.0.0/12"), (), True),
    (f"http://{STORE}/doc.pdf", (), (STORE,), False),
    ("http://my-service.local/api", (), ("My-Service.Local",), False),
    ("http://10.0.0.1/", (), ("allowed.internal",), True),
    ("file:///etc/passwd", (), ("anything",), True),
    ("http://10.96.0.1/", ("10.96.0.0/12",), (STORE,), False),
    (f"http://{STORE}/doc.pdf", ("10.96.0.0/12",), (STORE,), False),
    ("http://10.0.0.1/", ("10.96.0.0/12",), (STORE,), True),
    ("http://0x7f.1/", (), (), True),
    ("http://[::1]:8080/", (), (), True),
    ("http://[::ffff:7f00:1]/", (), (), True),
    ("http://%31%30.0.0.1/", (), (), True),
    ("http:\\\\10.0.0.1\\x", (), (), True),
    ("http:///10.0.0.1/", (), (), True),
    # Octets out of range do not make a range; the added mapped 172.16 block.
    ("http://44.0.0.1/", ("300.0.0.0/8",), (), False),
    ("http://[::ffff:172.20.0.1]/", (), (), True),
    ("http://[::1abc]/", (), (), True),
]


def test_guard_cases(spark):
    for cidrs, hosts in {(c, h) for _, c, h, _ in CASES}:
        mine = [(u, b) for u, c, h, b in CASES if (c, h) == (cidrs, hosts)]
        rows = spark.createDataFrame(mine, "url string, blocked boolean")
        wrong = rows.filter(guard_error(F.col("url"), cidrs, hosts).isNotNull() != F.col("blocked")).collect()
        assert not wrong, (cidrs, hosts, wrong)


def test_messages(spark):
    rows = spark.createDataFrame([("nope",), ("gopher://x.org/",), ("http://10.1.1.1/",)], "url string")
    got = [r.e for r in rows.select(guard_error(F.col("url")).alias("e")).collect()]
    assert got == [INVALID, "Protocol gopher: is not allowed", PRIVATE]


def test_names_and_redirects(spark):
    rows = spark.createDataFrame(
        [
            (1, "http://good.org/", "http://good.org/"),
            (2, "http://bad.org/", "http://bad.org/"),
            (3, "http://good.org/a", "http://bad.org/"),
            (4, "http://good.org/b", "http://10.0.0.1/"),
            (5, "http://nowhere.org/", "http://nowhere.org/"),
        ],
        "page_id long, url string, final_url string",
    )
    dns = spark.createDataFrame(
        [("good.org", "93.184.216.34"), ("BAD.org", "93.184.216.34"), ("bad.org", "fd00::1")],
        "host string, addr string",
    )
    got = {r.page_id: (r.guard_error, r.redirect_error) for r in guard(rows, dns=dns).collect()}
    blocked = "Redirect target blocked by SSRF guard: "
    assert got == {
        1: (None, None),
        2: (PRIVATE, None),
        3: (None, blocked + "http://bad.org/"),
        4: (None, blocked + "http://10.0.0.1/"),
        5: (None, None),
    }


def test_range_table_agrees_with_list(spark):
    addresses = spark.createDataFrame(
        [(i, f"10.{i % 256}.{i % 7}.1") for i in range(600)] + [(1000, "fd00::1"), (1001, "8.8.8.8")],
        "id long, addr string",
    )
    cidrs = ["10.96.0.0/12", "10.3.0.0/16", "0.0.0.0/33", "10.5.5.0/24"]
    table = address_verdicts(addresses, spark.createDataFrame([(c,) for c in cidrs], "cidr string"))
    listed = addresses.select(
        "id", guard_error(F.concat(F.lit("http://"), "addr", F.lit("/")), tuple(cidrs)).isNotNull().alias("b")
    )
    both = table.join(listed, "id").filter("NOT (addr LIKE '%:%')")
    assert both.filter("blocked <> b").count() == 0
    assert table.filter("addr = 'fd00::1'").first().blocked


@pytest.mark.parametrize("host", ["LOCALHOST", "10.0.0.1"])
def test_host_table(spark, host):
    rows = spark.createDataFrame([(f"http://{host}/",), (f"ftp://{host}/",)], "url string")
    got = allow_hosts(rows, spark.createDataFrame([(host,)], "host string")).orderBy("url").collect()
    assert [r.host_allowed for r in got] == [True, True]
    assert [r.guard_error for r in got] == ["Protocol ftp: is not allowed", None]
