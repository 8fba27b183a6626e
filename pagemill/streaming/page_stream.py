"""Newly arriving pages: the batch job run on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.layout import shared_folder


def stream_pages(
    spark: SparkSession,
    source: str,
    schema: str,
    job: Callable[[DataFrame], DataFrame],
    target: str | None = None,
    checkpoint: str | None = None,
    *,
    max_files: int | None,
    once_within: str | None = None,
) -> str:
    """Run `job` on each batch of files under `source`; returns the folder with
    its output. `max_files` bounds a batch; None takes all that is there as one.
    Target and checkpoint have to be in storage that all executors share; left
    out, they are new folders under spark.checkpoint.dir. A batch that is run again after a failure replaces its own
    folder.

    With `once_within`, an interval such as '7 days', a page_id that is delivered again
    within that time of its first delivery is left out, in the same batch, in a later one
    or after a restart; of rows in one batch any one stays. The time of a delivery is that
    of its file, and files older than the newest by more than the interval are late and
    left out. The state holds a key and a time per page delivered within the interval;
    RocksDB as state store keeps it on disk. Null ids are one page."""
    target = target or shared_folder(spark, "pages")
    checkpoint = checkpoint or shared_folder(spark, "pages-checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    arrivals = reader.parquet(source)
    if once_within is not None:
        timed = arrivals.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))
        arrivals = timed.withWatermark("_arrived", once_within).dropDuplicatesWithinWatermark(["page_id"]).drop("_arrived")
    query = (
        arrivals
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target
