"""Blocks of keys that send too many requests, on a stream of log rows.

The state of a key is small: for each window that may still change the least
times of it, one more than the limit, and the block that may still grow. Timers
on event time close both. Before the shuffle a task keeps only the rows of a
batch that could be among those least times, so a key that sends a large part
of all requests reaches its task as a few rows per window and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.layout import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(spark: SparkSession, span: str) -> int:
    """Length of an interval of days or less."""
    return spark.range(1).select(F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {span}"))).first()[0]


def least_times(log: DataFrame, requests: int, window: int) -> DataFrame:
    """Rows of a streaming `log(key, ts)` that could be among the first
    `requests` + 1 of their key and window: (key, ts, at, counts).

    Of each batch of rows in a task the latest one goes on as well, with
    `counts` false where it is not among them, so that the watermark is that
    of all rows.
    """
    rows = log.filter("ts IS NOT NULL AND key IS NOT NULL").select(
        "key", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column("at").to_numpy()
            keys = batch.column("key").dictionary_encode().indices.to_numpy()
            start = at // window
            order = np.lexsort((at, start, keys))
            first = np.r_[True, (np.diff(keys[order]) != 0) | (np.diff(start[order]) != 0)]
            places = np.arange(len(order))
            rank = places - np.maximum.accumulate(np.where(first, places, 0))
            kept = order[rank <= requests]
            counts = np.ones(len(kept), bool)
            latest = int(at.argmax())
            if latest not in kept:
                kept, counts = np.append(kept, latest), np.append(counts, False)
            out = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(counts)], names=[*out.schema.names, "counts"])

    kind = log.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ts timestamp, at long, counts boolean")


class Blocks(StatefulProcessor):
    """State per key: `times` (of each open window its least times) and `block` (the one that may still grow).

    Every call to the state goes to another process, so the windows of a key are
    one value, and a timer is set only for the first of them to end.
    """

    def __init__(self, requests: int, window: int, length: int) -> None:
        self.requests, self.window, self.length = requests, window, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "starts array<long>, times array<array<long>>")
        self.block = handle.getValueState("block", "since long, until long")

    def close(self) -> None:
        pass

    def wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def held(self) -> dict[int, list[int]]:
        got = self.times.get()
        return {s: list(at) for s, at in zip(got[0], got[1], strict=True)} if got else {}

    def hold(self, times: dict[int, list[int]]) -> None:
        if times:
            self.times.update((list(times), list(times.values())))
        else:
            self.times.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        times = None
        for batch in rows:
            at = batch["at"].to_numpy()[batch["counts"].to_numpy(dtype=bool)]
            # Windows that ended are closed; rows for them are late.
            at = np.sort(at[at // self.window * self.window + self.window > now])
            if not len(at):
                continue
            if times is None:
                times = self.held()
                first = min(times, default=None)
            starts, places = np.unique(at // self.window * self.window, return_index=True)
            for start, new in zip(starts.tolist(), np.split(at, places[1:]), strict=True):
                new = new[: self.requests + 1].tolist()
                times[start] = sorted(times[start] + new)[: self.requests + 1] if start in times else new
        if times:
            self.hold(times)
            if first is None or min(times) < first:
                self.wake(min(times) + self.window)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        closed = []
        block = old = self.block.get() or None
        block = tuple(block) if block else None
        times = self.held()
        done = sorted(s for s in times if s + self.window <= now)
        for start in done:
            at = times.pop(start)
            if len(at) <= self.requests:
                continue
            since = at[self.requests]
            if block and since <= block[1]:
                block = (block[0], max(block[1], since + self.length))
            else:
                closed += [block] if block else []
                block = (since, since + self.length)
        if done:
            self.hold(times)
            if times:
                self.wake(min(times) + self.window)
        if block:
            # Any later block starts in a window that is still open.
            final = block[1] // self.window * self.window + self.window
            if final <= now:
                closed.append(block)
                block = None
            else:
                self.wake(final)
        if block:
            self.block.update(block)
        elif old:
            self.block.clear()
        if closed:
            yield pd.DataFrame({"key": [key[0]] * len(closed), "since": [a for a, _ in closed], "until": [b for _, b in closed]})


def blocks(log: DataFrame, requests: int, duration: str, block: str, delay: str) -> DataFrame:
    """(key, blocked_from, blocked_until) of a streaming `log(key, ts)`, each
    when it can no longer grow: `limits.block_intervals` of the rows that were
    in time.

    A row is late, and left out, when it is more than `delay` older than the
    latest time of the batches before its own; so are rows without a time or a
    key, as in the batch form. Spans are fixed lengths. State per key:
    `requests` + 1 times for each window that ended less than `delay` ago or
    not at all, and one block.
    """
    spark = log.sparkSession
    window, length = micros(spark, duration), micros(spark, block)
    rows = least_times(log, requests, window).withWatermark("ts", delay)
    kind = log.schema["key"].dataType.simpleString()
    found = rows.groupBy("key").transformWithStateInPandas(
        Blocks(requests, window, length), f"key {kind}, since long, until long", "append", "eventTime"
    )
    return found.select(
        "key", F.timestamp_micros("since").alias("blocked_from"), F.timestamp_micros("until").alias("blocked_until")
    )


def run_blocks(
    spark: SparkSession,
    log: DataFrame,
    requests: int,
    duration: str,
    block: str,
    delay: str,
    target: str | None = None,
    checkpoint: str | None = None,
) -> str:
    """Take what is there now and append the closed blocks under `target`.

    Started again with the same folders, it goes on where it stopped. State is
    kept by RocksDB on the executors and in the checkpoint.
    """
    target = target or shared_folder(spark, "blocks")
    checkpoint = checkpoint or shared_folder(spark, "blocks-checkpoint")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = (
            blocks(log, requests, duration, block, delay)
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", target)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return target
