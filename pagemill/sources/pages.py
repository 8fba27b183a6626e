"""Stored pages in, results and errors out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import url_parts
from pagemill.operators.outcomes import summary_figures

PAGE_SCHEMA = "page_id BIGINT, url STRING, html STRING"
CRAWL_SCHEMA = (
    "page_id BIGINT, url STRING, final_url STRING, status INT, content_type STRING, "
    "html STRING, body BINARY, fetch_error STRING"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_crawl(pages: DataFrame, status: Column | None = None) -> DataFrame:
    """Bare pages count as fetched from their own URL, with status 200 unless told otherwise."""
    return pages.select(
        "page_id",
        "url",
        F.col("url").alias("final_url"),
        (F.lit(200) if status is None else status).alias("status"),
        F.lit("text/html").alias("content_type"),
        "html",
        F.lit(None).cast("binary").alias("body"),
        F.lit(None).cast("string").alias("fetch_error"),
    )


def save_crawl(crawl: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """A crawl saved once in buckets of `page_id`: what is joined to it by that
    key later comes to the pages, which are not moved again. A bucket is best a
    few hundred MB."""
    dealt = crawl.repartition(buckets, "page_id")
    dealt.write.bucketBy(buckets, "page_id").option("path", path).saveAsTable(table)
    return crawl.sparkSession.table(table)


def write_results(
    results: DataFrame,
    path: str,
    buckets: int = 64,
    fmt: str = "parquet",
    mode: str = "overwrite",
    seen: Observation | None = None,
):
    """Results by hash bucket of their host. The rebalance hint gives each
    bucket few files and splits a bucket that one host makes large.

    `seen` is filled by the same pass; `outcomes.observed_summary` reads it. It looks at
    the rows after the shuffle, where a task that runs again is counted once."""
    bucket = F.pmod(F.xxhash64(url_parts(F.col("url"))["host"]), F.lit(buckets)).cast("int")
    keyed = results.withColumn("host_bucket", bucket).hint("rebalance", "host_bucket")
    if seen is not None:
        keyed = keyed.observe(seen, *summary_figures())
    keyed.write.mode(mode).partitionBy("host_bucket").format(fmt).save(path)


def write_errors(errors: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite"):
    """Errors by status."""
    errors.hint("rebalance", "http_status").write.mode(mode).partitionBy("http_status").format(fmt).save(path)
