"""Request limits over a log `(event_id, key, ts)`.

One key may send a large part of all requests. Counts combine before the
shuffle. The request that reaches a limit is found by radix selection, whatever
the limit: counts per slice of time name the slice that holds it, counts per part
of that slice the part, then parts of the ids of one moment, until few requests
are left to be ranked. In joins back to the log hot keys are shared by tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators import layout
from pagemill.operators.layout import hot_keys, shared_keys, stored

# Default policy.
REQUESTS, DURATION, BLOCK = 60, "1 minute", "5 minutes"
# Parts of a window that are counted apart.
SLICES = 256
# Requests of one key and window that a task ranks at most, and the parts into
# which more of them are counted.
RANKED, PARTS = 100_000, 4096
# What the requests are counted by.
WHOLE = ["key", "window_start"]


def _span(text: str) -> Column:
    return F.expr(f"INTERVAL {text}")


def _met(log: DataFrame, known: DataFrame, hot: DataFrame) -> DataFrame:
    """`log` joined with `known` on key and window; hot ones are shared by tasks."""
    rows, known = shared_keys(log, known, hot, WHOLE, F.xxhash64("event_id"))
    return rows.join(known, [*WHOLE, "_salt"]).drop("_salt")


def with_window(log: DataFrame, duration: str = DURATION) -> DataFrame:
    """Add `window_start`; windows are aligned to the epoch."""
    return log.withColumn("window_start", F.window("ts", duration)["start"])


def request_counts(log: DataFrame, duration: str = DURATION) -> DataFrame:
    return with_window(log, duration).groupBy("key", "window_start").agg(F.count(F.lit(1)).alias("n_requests"))


def _counted(rows: DataFrame) -> DataFrame:
    """Of each key, window and `_digit` the range of times and ids, the number of
    requests, the number before them, and `_all`, that of the key and window."""
    counts = rows.groupBy(*WHOLE, "_digit").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("_before").alias("_before"),
        F.struct(F.min("_place").alias("first"), F.max("_place").alias("last")).alias("_time"),
        F.struct(F.min("event_id").alias("first"), F.max("event_id").alias("last")).alias("_id"),
    )
    whole = W.partitionBy(*WHOLE).orderBy("_digit")
    before = F.sum("_n").over(whole.rowsBetween(W.unboundedPreceding, -1))
    every = F.sum("_n").over(whole.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return counts.select("*", before.alias("_ahead"), every.alias("_all")).withColumn(
        "_before", F.col("_before") + F.coalesce("_ahead", F.lit(0))
    ).drop("_ahead")


def _holds(n: int) -> Column:
    """Is the n-th among the requests of a `_digit`?"""
    return (F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)


def _within(rows: DataFrame, ranges: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows inside the range of their key and window."""
    same_time = F.col("_time.first") == F.col("_time.last")
    return _met(rows, ranges, hot).filter(
        F.col("_place").between(F.col("_time.first"), F.col("_time.last"))
        & (~same_time | F.col("event_id").between(F.col("_id.first"), F.col("_id.last")))
    )


def _part(value: Column, span: Column) -> Column:
    """Which of PARTS equal parts of a range a value lies in; in the order of the values."""
    ahead = (value.cast("decimal(20,0)") - span["first"].cast("decimal(20,0)")).cast("double")
    width = (span["last"].cast("decimal(20,0)") - span["first"].cast("decimal(20,0)") + 1).cast("double")
    return F.floor(ahead * PARTS / width).cast("int")


def _candidates(log: DataFrame, n: int, duration: str, ranked: int) -> tuple[DataFrame, DataFrame]:
    """What `nth_candidates` gives, and the hot keys and windows, see `layout.hot_keys`."""
    place = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp"))
    end = F.unix_micros((F.col("window_start") + _span(duration)).cast("timestamp"))
    width = end - F.unix_micros(F.col("window_start").cast("timestamp"))
    rows = with_window(log, duration).withColumn("_place", place)
    first = rows.withColumn("_digit", F.floor(place * SLICES / width).cast("int")).withColumn("_before", F.lit(0).cast("long"))
    many_in_all = F.col("_all") > layout.HOT
    slices = stored(_counted(first).filter(_holds(n) | many_in_all), "slices")
    hot = slices.filter(many_in_all).groupBy(*WHOLE).agg(F.ceil(F.max("_all") / layout.HOT).cast("int").alias("_shares"))
    ranges = slices.filter(_holds(n)).drop("_digit", "_all")
    by_id = dict(log.dtypes)["event_id"] in ("tinyint", "smallint", "int", "bigint")
    same_time = F.col("_time.first") == F.col("_time.last")
    differs = ~same_time | (F.col("_id.first") < F.col("_id.last")) if by_id else ~same_time
    many = (F.col("_n") > ranked) & differs
    while not ranges.filter(many).isEmpty():
        inside = _within(rows, ranges.filter(many).drop("_n"), hot)
        digit = _part(F.col("_place"), F.col("_time"))
        if by_id:
            digit = F.when(same_time, _part(F.col("event_id"), F.col("_id"))).otherwise(digit)
        finer = _counted(inside.withColumn("_digit", digit)).filter(_holds(n)).drop("_digit", "_all")
        ranges = stored(ranges.filter(~many).unionByName(finer), "parts")
    return _within(rows, ranges.drop("_n"), hot).drop("_time", "_id", "_place"), hot


def nth_candidates(log: DataFrame, n: int, duration: str = DURATION, ranked: int = RANKED) -> DataFrame:
    """The requests among which the n-th of their key and window is: at most
    `ranked` different ones of each, `_before` others come before them.

    The rounds run when this is called; what they store is a row per key and
    window. A round counts requests, combined before the shuffle; only the keys
    and windows with more than `ranked` requests in their part go through the
    next one. Ids have to be whole numbers for parts of one moment to be told
    apart; others are ranked as they are.
    """
    return _candidates(log, n, duration, ranked)[0]


def _nth(log: DataFrame, n: int, duration: str, ranked: int = RANKED) -> tuple[DataFrame, DataFrame]:
    """What `nth_request` gives, and the hot keys and windows."""
    among, hot = _candidates(log, n, duration, ranked)
    # Repeated requests are one with a count, so they are not gathered.
    same = among.groupBy("key", "window_start", "ts", "event_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("_before").alias("_before"), F.first(F.struct(*log.columns)).alias("_row")
    )
    order = W.partitionBy("key", "window_start").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = same.withColumn("_upto", F.col("_before") + F.sum("_n").over(order))
    return upto.filter((F.col("_upto") >= n) & (F.col("_upto") - F.col("_n") < n)).select("_row.*", "window_start"), hot


def nth_request(log: DataFrame, n: int, duration: str = DURATION, ranked: int = RANKED) -> DataFrame:
    """The n-th request, by time and id, of each key and window that has so many."""
    return _nth(log, n, duration, ranked)[0]


def over_limit_requests(log: DataFrame, requests: int = REQUESTS, duration: str = DURATION) -> DataFrame:
    """Requests after the first `requests` of their key and window."""
    nth, hot = _nth(log, requests, duration)
    last = nth.select("key", "window_start", F.struct(F.col("ts"), F.col("event_id")).alias("_last"))
    return (
        _met(with_window(log, duration), last, hot)
        .filter(F.struct(F.col("ts"), F.col("event_id")) > F.col("_last"))
        .select("event_id", "key", "ts", "window_start")
    )


def block_intervals(
    log: DataFrame, requests: int = REQUESTS, duration: str = DURATION, block: str | None = BLOCK
) -> DataFrame:
    """(key, blocked_from, blocked_until): the first request over the limit in
    a window opens a block; overlapping blocks of a key are one. The windows
    below see one row per key and time window, never the requests."""
    first = nth_request(log, requests + 1, duration)
    if block is None:
        return first.filter(F.lit(False)).select(
            "key", F.col("ts").alias("blocked_from"), F.col("ts").alias("blocked_until")
        )
    opened = first.select("key", F.col("ts").alias("from_ts"), (F.col("ts") + _span(block)).alias("until_ts"))
    order = W.partitionBy("key").orderBy("from_ts", "until_ts")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    islands = opened.withColumn(
        "_new", F.when(F.col("from_ts") <= F.max("until_ts").over(before), 0).otherwise(1)
    ).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy("key", "_island").agg(
        F.min("from_ts").alias("blocked_from"), F.max("until_ts").alias("blocked_until")
    ).drop("_island")


def blocked_requests(log: DataFrame, intervals: DataFrame, slot: str = BLOCK) -> DataFrame:
    """Requests with `blocked_from < ts <= blocked_until` of their key.

    Blocks are cut into slots of time, so that requests and blocks meet on
    (key, slot) and not on the key alone. `slot` is best the block length.
    """
    cut = intervals.withColumn("_from_slot", F.window("blocked_from", slot)["start"]).withColumn(
        "_slot", F.explode(F.sequence(F.col("_from_slot"), F.col("blocked_until"), _span(slot)))
    )
    rows, met = log.withColumn("_slot", F.window("ts", slot)["start"]), ["key", "_slot"]
    rows, pieces = shared_keys(
        rows, cut.select(*met, "blocked_from", "blocked_until"), hot_keys(rows, met), met, F.xxhash64("event_id")
    )
    pieces = pieces.withColumnsRenamed({"key": "_key", "_slot": "_piece_slot", "_salt": "_piece_salt"})
    test = (
        (F.col("key") == F.col("_key"))
        & (F.col("_slot") == F.col("_piece_slot"))
        & (F.col("_salt") == F.col("_piece_salt"))
        & (F.col("ts") > F.col("blocked_from"))
        & (F.col("ts") <= F.col("blocked_until"))
    )
    return rows.join(pieces, test, "left_semi").select("event_id", "key", "ts")
