"""Request counts on a stream of log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.layout import shared_folder


def counts(log: DataFrame, duration: str, delay: str) -> DataFrame:
    """Requests per key and closed window of a streaming `log(key, ts)`; rows
    later than the watermark are left out."""
    return (
        log.withWatermark("ts", delay)
        .groupBy(F.window("ts", duration).alias("w"), "key")
        .agg(F.count(F.lit(1)).alias("n_requests"))
        .select("key", F.col("w.start").alias("window_start"), "n_requests")
    )


def run_counts(
    spark: SparkSession,
    log: DataFrame,
    duration: str,
    delay: str,
    target: str | None = None,
    checkpoint: str | None = None,
) -> str:
    """Count what is there now and append the closed windows under `target`."""
    target = target or shared_folder(spark, "counts")
    checkpoint = checkpoint or shared_folder(spark, "counts-checkpoint")
    query = (
        counts(log, duration, delay)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target
