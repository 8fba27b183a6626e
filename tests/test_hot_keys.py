"""Joins with hot keys: only hot ones are written more than once, and results are those of brute force."""

import random

import pytest
from pyspark.sql import functions as F
from test_limits import N, brute, frame, log  # noqa: F401

from pagemill.api import block_intervals, blocked_requests, over_limit_requests
from pagemill.operators import layout
from pagemill.operators.layout import hot_keys, mark_known, shared_keys


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def copies(rows) -> bool:
    """Does the plan write each row once per shuffle partition?"""
    return "58,59,60]" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_known_keys_are_not_copied_per_partition(spark, many_partitions):
    rows = spark.range(3000).selectExpr("CAST(id % 1000 AS string) AS addr")
    marked = mark_known(rows, spark.range(900).selectExpr("CAST(id AS string) AS addr"), "addr", "hit")
    assert not copies(marked)
    assert marked.filter("hit").count() == 2700


def test_requests_meet_without_copies(spark, log, many_partitions):  # noqa: F811
    rows = frame(spark, log)
    blocks = block_intervals(rows, N)
    assert not any(copies(x) for x in (blocks, over_limit_requests(rows, N), blocked_requests(rows, blocks)))


def test_shares_of_hot_keys(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 700, 1).when(F.col("id") < 950, F.col("id")).alias("k"))
    known = spark.createDataFrame([(1,), (750,), (5000,)], "k long")
    left, right = shared_keys(rows, known, hot_keys(rows, ["k"], 100), ["k"], F.monotonically_increasing_id())
    assert right.groupBy("k").count().rdd.collectAsMap() == {1: 7, 750: 1, 5000: 1}
    assert left.filter("k = 1").groupBy("_salt").count().agg(F.count("*"), F.max("count")).first()[0] == 7
    assert left.filter("k > 1").agg(F.max("_salt")).first()[0] == 0
    assert left.filter("k IS NULL").select("_salt").distinct().count() > 40
    assert left.join(right, ["k", "_salt"]).count() == 701


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_results_whatever_is_hot(spark, log, monkeypatch, most):  # noqa: F811
    monkeypatch.setattr(layout, "HOT", most)
    _, over, merged, inside = brute(log)
    rows = frame(spark, log)
    assert {r.event_id for r in over_limit_requests(rows, N).collect()} == over
    blocks = block_intervals(rows, N)
    assert {tuple(r) for r in blocks.collect()} == merged
    assert sorted(r.event_id for r in blocked_requests(rows, blocks).collect()) == sorted(inside)
    rng = random.Random(most)
    keys = [rng.choice(["a", "a", "a", "b", "b", None, str(rng.randrange(50))]) for _ in range(600)]
    marked = mark_known(spark.createDataFrame([(k,) for k in keys], "k string"), spark.createDataFrame([("a",), ("a",), ("7",), (None,)], "k string"), "k", "hit")
    assert sorted(map(str, (tuple(r) for r in marked.collect()))) == sorted(str((k, k in ("a", "7"))) for k in keys)
