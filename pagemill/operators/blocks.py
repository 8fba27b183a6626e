"""Blocks of text of a page: cutting, structure, features, main content.

All page work is keyed by `page_id`, one row per page. Cutting a page, writing
its inline Markdown and counting its words happen inside the scan; only the
short block rows are shuffled, once, for the windows that look across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import inline
from pagemill.functions.markup import raw_attribute, tag_of
from pagemill.functions.reuse import reuse

LIST_TAGS = ("ul", "ol", "menu", "dir")

# Word-count tree for main content (shallow text features). Link
# densities 1/3 and 5/9 are compared as whole numbers.
WORDS_SELF, WORDS_NEXT, WORDS_PREVIOUS = 16, 15, 4
WORDS_SELF_AFTER_LINKS, WORDS_NEXT_AFTER_LINKS = 40, 17


@reuse
def _chunks(absolute: bool) -> Column:
    return inline.marked_blocks(F.col("html"), F.col("_base") if absolute else None)


@reuse
def _features() -> dict[str, Column]:
    """Columns over `head`, `body`, `tag`, `closing`, `shows` and `parts`."""
    body, tag, parts = F.col("body"), F.col("tag"), F.col("parts")
    opened = ~F.col("closing")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    rule = opened & (tag == "hr")
    shows = F.col("shows")
    text = (
        F.when(~shows, F.lit(""))
        .when(opened & level.isNotNull(), inline.heading(parts, level))
        .when(opened & (tag == "pre"), inline.code_block(body, F.col("head")))
        .when(opened & (tag == "table"), inline.table(parts))
        .when(rule, inline.rule_line(parts))
        .otherwise(inline.paragraph(parts))
    )
    h1 = F.when(
        opened & (tag == "h1"),
        F.trim(
            F.regexp_replace(inline.unescape_text(inline.visible_text(body)), r"[ \t\r\n\f\x{A0}]+", " ")
        ),
    )
    start = F.when(
        opened & (tag == "ol"),
        F.coalesce(raw_attribute(F.col("head"), "start").try_cast("int"), F.lit(1)),
    )
    words = F.when(shows, inline.word_count(inline.visible_text(body))).otherwise(0)
    return {
        "parts": F.when(shows, inline.inline_parts(body, tag, opened)),
        "start": start,
        "text": text,
        "h1": h1,
        "words": words,
        "link_words": inline.link_word_count(body),
    }


def page_blocks(pages: DataFrame, base: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per block that shows something or shapes the page.

    `base` is a split URL (see `functions.urls.url_parts`) that makes links
    absolute. The columns in `carry` ride on block 0 only, as struct `page`.
    Pages are cut where they are read; give an input of few splits more files.
    """
    wanted = ["page_id", "html", *[c for c in carry if c not in ("page_id", "html")]]
    source = pages.select(*wanted, *([] if base is None else [base.alias("_base")]))
    page = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(1).alias("_none"))
    # The outer form: the plain one would have Spark cut every page twice, first
    # in a filter for pages without blocks. Every page has at least one.
    rows = source.select(
        "page_id", page.alias("page"), F.posexplode_outer(_chunks(base is not None)).alias("block_id", "chunk")
    ).select(
        "page_id",
        "block_id",
        F.when(F.col("block_id") == 0, F.col("page")).alias("page"),
        F.substring_index("chunk", inline.BODY, 1).alias("head"),
        F.substring_index("chunk", inline.BODY, -1).alias("body"),
    )
    closing = F.col("head").startswith("</")
    rule = (F.col("tag") == "hr") & ~F.col("closing")
    shapes = F.col("tag").isin(*LIST_TAGS, "blockquote") | ((F.col("tag") == "li") & ~F.col("closing"))
    rows = (
        rows.select("*", closing.alias("closing"), tag_of(F.col("head")).alias("tag"))
        .withColumn("shows", inline.has_content(F.col("body")) | rule)
        .filter(F.col("shows") | shapes | (F.col("block_id") == 0))
    )
    made = _features()
    return rows.withColumn("parts", made["parts"]).select(
        "page_id",
        "block_id",
        "page",
        "tag",
        "closing",
        "shows",
        *[made[name].alias(name) for name in ("start", "text", "h1", "words", "link_words")],
    )


def with_structure(blocks: DataFrame) -> DataFrame:
    """Add list depth, list identity, item number and quote depth.

    Depths are running sums of opening and closing tags, held at zero from
    below, so that stray closing tags do not leak. Blocks are dealt out here even
    where their pages lie by `page_id` already: they may be a hundred times the
    pages' size, and tasks are best cut by what is sorted. Blocks are sorted
    three times, by page, by page and depth, and by page again.
    """
    opened = ~F.col("closing")
    is_list = F.col("tag").isin(*LIST_TAGS)
    is_quote = F.col("tag") == "blockquote"
    is_item = (F.col("tag") == "li") & opened
    item = F.when(is_item, 1).otherwise(0)
    seen = F.when(F.col("shows") & (F.col("text") != ""), 1).otherwise(0)

    def step(test: Column) -> Column:
        return F.when(test, F.when(opened, 1).otherwise(-1)).otherwise(0)

    order = W.partitionBy("page_id").orderBy("block_id")
    running = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = blocks.hint("rebalance", "page_id").select(
        "*",
        F.sum(step(is_list)).over(running).alias("_lists"),
        F.sum(step(is_quote)).over(running).alias("_quotes"),
        F.sum(item).over(running).alias("item"),
        F.sum(seen).over(running).alias("_shown"),
    )
    # What was shown before the item began.
    earlier = F.last(F.when(is_item, F.col("_shown") - seen), ignorenulls=True).over(running)
    out = out.select(
        "*",
        (F.col("_lists") - F.least(F.lit(0), F.min("_lists").over(running))).alias("list_depth"),
        (F.col("_quotes") - F.least(F.lit(0), F.min("_quotes").over(running))).alias("quote_depth"),
        (F.col("_shown") - F.coalesce(earlier, F.lit(0))).alias("_seen"),
    ).drop("_lists", "_quotes", "_shown")

    level = (
        W.partitionBy("page_id", "list_depth")
        .orderBy("block_id")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    opener = F.when(is_list & opened, F.struct("block_id", "tag", "start"))
    out = out.select("*", F.max(opener).over(level).alias("_list"), F.sum(item).over(level).alias("_items"))
    # The items of this depth before the list began.
    others = F.last(F.when(opener.isNotNull(), F.col("_items")), ignorenulls=True).over(level)
    out = out.select(
        "*", F.col("_list.block_id").alias("list_id"), (F.col("_items") - F.coalesce(others, F.lit(0))).alias("_nth")
    )
    number = F.when(
        is_item & (F.col("list_depth") > 0) & (F.col("_list.tag") == "ol"),
        F.col("_list.start") + F.col("_nth") - 1,
    )
    own = F.last(F.when(is_item, F.struct(number.alias("number"))), ignorenulls=True).over(running)
    leads = (
        F.col("shows") & (F.col("text") != "") & (F.col("item") > 0) & (F.col("list_depth") > 0) & (F.col("_seen") == 1)
    )
    return out.select("*", own["number"].alias("number"), leads.alias("leads_item")).drop(
        "_list", "_items", "_nth", "_seen"
    )


def with_keep(blocks: DataFrame) -> DataFrame:
    """Main-content choice from each block and its neighbours; a page where
    nothing is kept keeps everything. Only blocks that show something count."""
    order = W.partitionBy("page_id").orderBy("block_id")
    shown = blocks.filter(F.col("shows") | (F.col("block_id") == 0))

    def near(fn, name: str) -> Column:
        return fn(name, 1, 0).over(order)

    out = shown.select(
        "*",
        near(F.lag, "words").alias("_pw"),
        near(F.lag, "link_words").alias("_pl"),
        near(F.lead, "words").alias("_nw"),
    )
    keep = (
        F.when(~F.col("shows"), False)
        .when(3 * F.col("link_words") > F.col("words"), False)
        .when(
            9 * F.col("_pl") <= 5 * F.col("_pw"),
            (F.col("words") > WORDS_SELF) | (F.col("_nw") > WORDS_NEXT) | (F.col("_pw") > WORDS_PREVIOUS),
        )
        .otherwise((F.col("words") > WORDS_SELF_AFTER_LINKS) | (F.col("_nw") > WORDS_NEXT_AFTER_LINKS))
    )
    out = out.withColumn("main", keep).drop("_pw", "_pl", "_nw")
    any_kept = F.max("main").over(W.partitionBy("page_id"))
    return out.withColumn("fallback", ~any_kept).withColumn(
        "keep", F.col("shows") & (F.col("main") | F.col("fallback"))
    )


def keep_all(blocks: DataFrame) -> DataFrame:
    """The whole page as content, in the shape of `with_keep`."""
    return blocks.filter(F.col("shows") | (F.col("block_id") == 0)).select(
        "*", F.lit(True).alias("main"), F.lit(True).alias("fallback"), F.col("shows").alias("keep")
    )
