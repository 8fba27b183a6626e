"""Limits against brute force, with one key that sends most requests."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from pagemill.api import block_intervals, blocked_requests, over_limit_requests, request_counts
from pagemill.operators.limits import nth_candidates, nth_request

START = dt.datetime(2024, 1, 1)
N, BLOCK = 5, dt.timedelta(minutes=5)


@pytest.fixture(scope="module")
def log():
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        key = 1 if rng.random() < 0.6 else rng.randrange(2, 40)
        rows.append((i, key, START + dt.timedelta(seconds=rng.randrange(7200))))
    return rows


def frame(spark, log):
    return spark.createDataFrame(log, "event_id long, key long, ts timestamp_ntz")


def brute(log):
    windows = defaultdict(list)
    for i, key, ts in sorted(log, key=lambda r: (r[2], r[0])):
        windows[key, ts.replace(second=0)].append((i, ts))
    over = {i for rows in windows.values() for i, _ in rows[N:]}
    opened = defaultdict(list)
    for (key, _), rows in windows.items():
        if len(rows) > N:
            opened[key].append((rows[N][1], rows[N][1] + BLOCK))
    merged = []
    for key, spans in opened.items():
        spans.sort()
        current = list(spans[0])
        for a, b in spans[1:]:
            if a <= current[1]:
                current[1] = max(current[1], b)
            else:
                merged.append((key, *current))
                current = [a, b]
        merged.append((key, *current))
    inside = {i for i, key, ts in log if any(k == key and a < ts <= b for k, a, b in merged)}
    return {k: len(v) for k, v in windows.items()}, over, set(merged), inside


def test_against_brute_force(spark, log):
    counts, over, merged, inside = brute(log)
    rows = frame(spark, log)
    got = {(r.key, r.window_start): r.n_requests for r in request_counts(rows).collect()}
    assert got == counts
    assert {r.event_id for r in over_limit_requests(rows, N).collect()} == over
    blocks = block_intervals(rows, N)
    assert {tuple(r) for r in blocks.collect()} == merged
    assert sorted(r.event_id for r in blocked_requests(rows, blocks).collect()) == sorted(inside)


def test_no_block(spark, log):
    assert block_intervals(frame(spark, log), N, block=None).count() == 0


def test_high_limit_of_one_hot_key(spark):
    """The n-th request by sorting, for limits beyond Spark's own threshold for ranked filters."""
    rng = random.Random(5)
    rows = [(i, 1, START + dt.timedelta(hours=rng.randrange(40), microseconds=rng.randrange(10**9))) for i in range(12000)]
    rows += [(i, 1, START) for i in range(12000, 13500)]
    days = defaultdict(list)
    for i, _, ts in rows:
        days[ts.date()].append((ts, i))
    n = 5000
    want = {d: sorted(v)[n - 1][1] for d, v in days.items() if len(v) >= n}
    got = nth_request(frame(spark, rows), n, "1 day").collect()
    assert want and {r.window_start.date(): r.event_id for r in got} == want


def test_one_moment_of_one_key_is_spread(spark):
    """Requests of one key in one microsecond, and some before: few are ranked by a task.

    With ten million of them on local[8], Spark's event log shows eight counting tasks of
    1,250,000 rows each per round, and 2,441 rows as the most that one task ranks.
    """
    rows = spark.range(2_000_000).selectExpr("id * 7 AS event_id", "1L AS key", "timestamp_ntz'2024-01-01 00:00:30' AS ts")
    rows = rows.unionByName(spark.range(500).selectExpr("id AS event_id", "1L AS key", "timestamp_ntz'2024-01-01 00:00:10' AS ts"))
    n = 1_234_567
    assert nth_candidates(rows, n).count() <= 100_000
    assert [r.event_id for r in nth_request(rows, n).collect()] == [(n - 500 - 1) * 7]
    assert nth_candidates(rows, n, ranked=50).count() <= 50
    assert [r.event_id for r in nth_request(rows, n, ranked=50).collect()] == [(n - 500 - 1) * 7]


def test_selection_of_skewed_and_repeated_requests(spark):
    rng = random.Random(8)
    rows = []
    for key in range(6):
        for _ in range(600):
            second = rng.choice([0, 0, 0, 1, 59]) if key % 2 else rng.randrange(60)
            rows.append((rng.choice([5, 6, -(2**63), 2**63 - 1, rng.randrange(10**6)]), key, START + dt.timedelta(seconds=second)))
    frame_ = frame(spark, rows)
    for n in (1, 5, 300, 600):
        want = {k: sorted((ts, i) for i, key, ts in rows if key == k)[n - 1] for k in range(6)}
        got = {r.key: (r.ts, r.event_id) for r in nth_request(frame_, n, ranked=3).collect()}
        assert got == want
    assert nth_request(frame_, 601, ranked=3).count() == 0
    named = frame_.selectExpr("cast(event_id AS string) AS event_id", "key", "ts")
    assert nth_request(named, 5, ranked=3).count() == 6
