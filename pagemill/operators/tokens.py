"""The token table: one row per token of a stored page, with running state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.markup import BLOCK_TAGS, kind_of, tag_of, tokens_of
from pagemill.operators.blocks import LIST_TAGS


def tokens(pages: DataFrame, *carry: str) -> DataFrame:
    """(page_id, pos, kind, tag, raw). Joined in `pos` order, `raw` is the page.

    Whole pages are hashed by their key before they are cut: the windows over
    tokens then need no further shuffle, and a page is smaller than its tokens.
    """
    source = pages.select("page_id", "html", *carry).repartition("page_id")
    rows = source.select("page_id", *carry, F.posexplode_outer(tokens_of(F.col("html"))).alias("pos", "raw"))
    rows = rows.filter(F.col("raw").isNotNull())
    rows = rows.withColumn("tag", tag_of(F.col("raw")))
    return rows.withColumn("kind", kind_of(F.col("raw"), F.col("tag"))).select(
        "page_id", *carry, "pos", "kind", "tag", "raw"
    )


def _step(test):
    return F.when(test & (F.col("kind") == "open"), 1).when(test & (F.col("kind") == "close"), -1).otherwise(0)


def with_blocks(rows: DataFrame) -> DataFrame:
    """Add `block_id`, the running count of block boundaries."""
    order = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    boundary = F.col("tag").isin(*BLOCK_TAGS) & F.col("kind").isin("open", "close", "void")
    return rows.withColumn("block_id", F.sum(F.when(boundary, 1).otherwise(0)).over(order))


def with_depth(rows: DataFrame) -> DataFrame:
    """Add `list_depth` and `quote_depth`, held at zero from below."""
    order = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = rows.select(
        "*",
        F.sum(_step(F.col("tag").isin(*LIST_TAGS))).over(order).alias("_lists"),
        F.sum(_step(F.col("tag") == "blockquote")).over(order).alias("_quotes"),
    )
    return out.select(
        "*",
        (F.col("_lists") - F.least(F.lit(0), F.min("_lists").over(order))).alias("list_depth"),
        (F.col("_quotes") - F.least(F.lit(0), F.min("_quotes").over(order))).alias("quote_depth"),
    ).drop("_lists", "_quotes")
