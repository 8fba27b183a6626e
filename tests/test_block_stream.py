"""Blocks on a stream against the batch form, under several splits and after a restart."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagemill.operators.limits import block_intervals
from pagemill.streaming.block_stream import Blocks, run_blocks

START = dt.datetime(2024, 1, 1)
N, DELAY = 5, dt.timedelta(minutes=2)
SCHEMA = "event_id long, key string, ts timestamp"


def log_rows(seed, n=2500):
    """Rows in the order of their arrival: at most the delay behind the latest one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        seconds = i * 2 + rng.randrange(100)
        if key in ("a", "b", None) and seconds // 900 % 2:
            continue  # quiet for a while, so that blocks close
        rows.append((i, key, START + dt.timedelta(seconds=seconds, microseconds=rng.randrange(10**6))))
    return rows


def written(spark, rows, folder, pieces, first=0):
    size = -(-len(rows) // pieces)
    for k in range(pieces):
        part = spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/part={first + k:03d}")


def stream(spark, folder):
    reader = spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1)
    return reader.parquet(folder).select("key", "ts")


def wanted(spark, rows, last=None):
    """Blocks of the batch form that can no longer grow."""
    log = spark.createDataFrame([r for r in rows if r[2]], SCHEMA)
    last = last or max(r[2] for r in rows if r[2]) - DELAY
    minute = dt.timedelta(minutes=1)
    out = set()
    for key, since, until in block_intervals(log, N, "1 minute", "3 minutes").collect():
        if until.replace(second=0, microsecond=0) + minute <= last:
            out.add((key, since, until))
    return out


def found(spark, target):
    return [tuple(r) for r in spark.read.parquet(target).collect()]


def run(spark, folder, out):
    return run_blocks(
        spark, stream(spark, folder), N, "1 minute", "3 minutes", "2 minutes", f"{out}/target", f"{out}/checkpoint"
    )


@pytest.mark.parametrize("pieces", [1, 4, 9])
def test_same_blocks_however_the_log_is_split(spark, tmp_path, pieces):
    rows = log_rows(1)
    rows += [(9999, "a", None)]
    written(spark, rows, tmp_path / "log", pieces)
    got = found(spark, run(spark, str(tmp_path / "log"), tmp_path))
    expected = wanted(spark, rows)
    assert len(expected) > 10 and {k for k, *_ in expected} >= {"a", "b"}
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_goes_on_after_a_restart_and_leaves_late_rows_out(spark, tmp_path):
    rows = log_rows(2)
    half = len(rows) // 2
    written(spark, rows[:half], tmp_path / "log", 3)
    run(spark, str(tmp_path / "log"), tmp_path)
    # Rows of an hour before would open blocks of their own; they are too late.
    late = [(9000 + i, "late", START + dt.timedelta(seconds=i)) for i in range(30)]
    written(spark, late + rows[half:], tmp_path / "log", 3, first=3)
    got = found(spark, run(spark, str(tmp_path / "log"), tmp_path))
    assert sorted(got, key=str) == sorted(wanted(spark, rows), key=str)


def test_few_rows_of_a_hot_key_are_shuffled(spark, tmp_path):
    from pagemill.streaming.block_stream import least_times

    rows = [(i, "hot", START + dt.timedelta(milliseconds=i)) for i in range(9000)]
    log = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    kept = least_times(log, N, 60_000_000)
    assert kept.count() == N + 2  # and the latest row, for the watermark
    assert kept.agg(F.max("ts")).first()[0] == rows[-1][2]


def test_nothing_there(spark, tmp_path):
    written(spark, log_rows(1, 3), tmp_path / "log", 1)
    assert found(spark, run(spark, str(tmp_path / "log"), tmp_path)) == []


def test_state_is_called_a_few_times_per_key():
    """However many windows a batch brings: each call goes to another process."""

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def __getattr__(self, name):
            raise AssertionError(name)

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

        def clear(self):
            self.calls += 1
            self.value = None

    class Handle:
        def __init__(self):
            self.states, self.timers = [], []

        def getValueState(self, *_):  # noqa: N802
            self.states.append(State())
            return self.states[-1]

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.now

    minute = 60_000_000
    found, handle = Blocks(2, minute, minute // 2), Handle()
    found.init(handle)
    at = [w * minute + s for w in range(100) for s in (5, 1, 3)]
    batches = [pd.DataFrame({"at": part, "counts": True}) for part in (at[:150], at[150:])]
    assert not list(found.handleInputRows((7,), iter(batches), Clock(0)))
    assert handle.timers == [60_000]
    [early] = found.handleExpiredTimer((7,), Clock(120_000), None)
    assert early.values.tolist() == [[7, w * minute + 5, w * minute + 5 + minute // 2] for w in range(2)]
    assert handle.timers == [60_000, 180_000]
    [rest] = found.handleExpiredTimer((7,), Clock(10**9), None)
    assert rest["since"].tolist() == [w * minute + 5 for w in range(2, 100)] and len(handle.timers) == 2
    assert sum(s.calls for s in handle.states) <= 12
