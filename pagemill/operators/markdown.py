"""Blocks to one Markdown text per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.operators.blocks import keep_all, page_blocks, with_keep, with_structure

INDENT = "    "


def block_markdown() -> Column:
    """Text of a block with its list marker, indentation and quote marks."""
    depth = F.col("list_depth")
    marker = F.when(
        F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(".  "))
    ).otherwise(F.lit("-   "))
    inner = F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(INDENT), depth)))
    listed = (
        F.when(F.col("leads_item"), F.concat(F.repeat(F.lit(INDENT), depth - 1), marker, inner))
        .when((depth > 0) & (F.col("item") > 0), F.concat(F.repeat(F.lit(INDENT), depth), inner))
        .otherwise(F.col("text"))
    )
    prefix = F.repeat(F.lit("> "), F.col("quote_depth"))
    quoted = let(
        prefix, lambda p: F.concat(p, F.replace(listed, F.lit("\n"), F.concat(F.lit("\n"), p)))
    )
    return F.when(F.col("text") == "", F.lit("")).when(F.col("quote_depth") > 0, quoted).otherwise(listed)


def _joined(blocks: Column) -> Column:
    """Blocks in page order: a blank line between them (quoted where both sides
    are), only a line end before an item that follows list text."""

    def gap(block: Column, i: Column) -> Column:
        before = F.element_at(blocks, i)
        shared = F.least(before["quote_depth"], block["quote_depth"])
        return (
            F.when(i == 0, F.lit(""))
            .when(block["leads_item"] & (before["list_depth"] > 0), F.lit("\n"))
            .otherwise(F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), shared)), F.lit("\n")))
        )

    return F.array_join(
        F.transform(blocks, lambda b, i: F.concat(gap(b, i), b["md"])), ""
    )


def assemble(blocks: DataFrame) -> DataFrame:
    """One row per page: page struct, markdown, article_title, kept blocks."""
    piece = F.struct(
        F.col("block_id"),
        block_markdown().alias("md"),
        "list_depth",
        "quote_depth",
        "leads_item",
    )
    ready = blocks.select(
        "page_id",
        "page",
        F.when(F.col("keep") & (F.col("text") != ""), piece).alias("piece"),
        F.when(F.col("keep") & ~F.col("fallback") & (F.col("h1") != ""), F.struct("block_id", "h1")).alias("_h1"),
    )
    grouped = ready.groupBy("page_id").agg(
        F.first("page", ignorenulls=True).alias("page"),
        F.array_sort(F.collect_list("piece")).alias("_blocks"),
        F.min("_h1").alias("_h1"),
    )
    return grouped.select(
        "page_id",
        "page",
        _joined(F.col("_blocks")).alias("markdown"),
        F.col("_h1.h1").alias("article_title"),
        F.size("_blocks").alias("n_blocks"),
    )


def to_markdown(
    pages: DataFrame,
    base: Column | None = None,
    carry: tuple[str, ...] = (),
    main_content: bool = True,
) -> DataFrame:
    """Markdown of every page in `pages(page_id, html, ...)`."""
    blocks = with_structure(page_blocks(pages, base, carry))
    return assemble(with_keep(blocks) if main_content else keep_all(blocks))
