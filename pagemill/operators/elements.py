"""The elements of a page as intervals: one row per element, with its place in the tree.

Everything is a running value over the tags of a page in order, so the work grows
with the number of tags, however deep they are nested. All windows are keyed by
the page (and something more), which one hash partitioning serves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.markup import BLOCK_TAGS, VOID_TAGS, kind_of, tag_of, tokens_of
from pagemill.operators.layout import deal_pages

# Elements whose end tag may be left out, and the elements whose
# start ends them.
_PARAGRAPH_ENDS = (
    "address", "article", "aside", "blockquote", "details", "dialog", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p",
    "pre", "search", "section", "table", "ul",
)
IMPLIED_ENDS = (
    (("li",), ("li",)),
    (("dt", "dd"), ("dt", "dd")),
    (("p",), _PARAGRAPH_ENDS),
    (("option",), ("option", "optgroup")),
    (("optgroup",), ("optgroup",)),
    (("td", "th"), ("td", "th", "tr", "tbody", "tfoot")),
    (("tr",), ("tr", "tbody", "tfoot")),
    (("thead", "tbody"), ("tbody", "tfoot")),
)

_LOOSE = tuple(t for own, _ in IMPLIED_ENDS for t in own)
_CONTAINERS = tuple(t for t in BLOCK_TAGS if t not in (*_LOOSE, *VOID_TAGS))

#: Beyond the end of any page.
PAGE_END = (1 << 31) - 1
_BEFORE = (W.unboundedPreceding, -1)
_UPTO = (W.unboundedPreceding, W.currentRow)


def tags(pages: DataFrame) -> DataFrame:
    """(page_id, at, size, kind, tag, raw) of the tags of `pages(page_id, html)`,
    which are hashed by page_id already; `at` is the place of the tag in the page."""
    rows = pages.select("page_id", F.posexplode(tokens_of(F.col("html"))).alias("pos", "raw"))
    order = W.partitionBy("page_id").orderBy("pos").rowsBetween(*_BEFORE)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("raw")).over(order), F.lit(0)))
    rows = rows.withColumn("tag", tag_of(F.col("raw")))
    rows = rows.select(
        "page_id", "at", F.length("raw").alias("size"), kind_of(F.col("raw"), F.col("tag")).alias("kind"), "tag", "raw"
    )
    return rows.filter(F.col("kind").isin("open", "close", "void"))


def _with_pairs(rows: DataFrame) -> DataFrame:
    """Add `ends`, of an opening tag the place of the end tag that belongs to it,
    or null, and `real`: does an end tag belong to an opening one? Tags of one
    name pair up like brackets."""
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    same = W.partitionBy("page_id", "tag").orderBy("at").rowsBetween(*_UPTO)
    rows = rows.withColumn("_sum", F.sum(step).over(same))
    depth = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(same))
    rows = rows.withColumn("_level", F.when(F.col("kind") == "close", depth + 1).otherwise(depth))
    pair = W.partitionBy("page_id", "tag", "_level").orderBy("at")
    return rows.select(
        "*",
        F.when((F.col("kind") == "open") & (F.lead("kind").over(pair) == "close"), F.lead("at").over(pair)).alias("ends"),
        ((F.col("kind") == "close") & F.coalesce(F.lag("kind").over(pair) == "open", F.lit(False))).alias("real"),
    ).drop("_sum", "_level")


def _with_scope(rows: DataFrame) -> DataFrame:
    """Add `scope` and `scope_end`: the place and end of the innermost paired
    container around a tag; null where there is none."""
    holds = F.col("tag").isin(*_CONTAINERS)
    step = F.when(holds & F.col("ends").isNotNull(), 1).when(holds & F.col("real"), -1).otherwise(0)
    order = W.partitionBy("page_id").orderBy("at").rowsBetween(*_UPTO)
    rows = rows.withColumn("_step", step).withColumn("_in", F.sum("_step").over(order))
    # A container is looked for at the level around it, and found at its own.
    levels = F.when(F.col("_step") == 1, F.array(F.col("_in"), F.col("_in") - 1)).otherwise(F.array(F.col("_in") - F.least("_step", F.lit(0))))
    rows = rows.withColumn("_l", F.explode(levels))
    found = (F.col("_step") == 1) & (F.col("_l") == F.col("_in"))
    before = W.partitionBy("page_id", "_l").orderBy("at", F.desc("_l")).rowsBetween(*_BEFORE)
    around = F.last(F.when(found, F.struct(F.col("at").alias("at"), F.col("ends").alias("ends"))), ignorenulls=True).over(before)
    rows = rows.withColumn("_a", F.when(F.col("_l") > 0, around)).filter(~found)
    return rows.select("*", F.col("_a.at").alias("scope"), F.col("_a.ends").alias("scope_end")).drop("_a", "_l", "_in", "_step")


def _with_ends(rows: DataFrame) -> DataFrame:
    """Elements with `post`, where they end: at their end tag, or where that is
    left out at the start of an element that ends them, or with their container,
    or the page. End tags that may be left out belong to the element of their
    name right before them in their container."""
    starts = F.col("kind") != "close"
    near = W.partitionBy("page_id", "scope", "tag").orderBy("at")
    loose = F.col("tag").isin(*_LOOSE)
    own = F.when((F.col("kind") == "open") & (F.lead("kind").over(near) == "close"), F.lead("at").over(near))
    rows = rows.withColumn("ends", F.when(loose, own).otherwise(F.col("ends")))
    after = W.partitionBy("page_id", "scope").orderBy(F.desc("at")).rowsBetween(*_BEFORE)
    ends = [F.col("scope_end")]
    for own_tags, enders in IMPLIED_ENDS:
        found = F.last(F.when(starts & F.col("tag").isin(*enders), F.col("at")), ignorenulls=True).over(after)
        ends.append(F.when(F.col("tag").isin(*own_tags), found))
    post = F.when(F.col("kind") == "void", F.col("at") + F.col("size")).otherwise(
        F.coalesce("ends", F.least(*ends), F.lit(PAGE_END))
    )
    return rows.withColumn("post", post).filter(starts).drop("ends", "real", "scope", "scope_end")


def _events(rows: DataFrame) -> DataFrame:
    """A row where an element begins and one where it ends (`_p`, `_d`), in order,
    with `_open`, the number of elements open after it. What ends somewhere ends
    before anything begins there."""
    width = F.when(F.col("kind") == "void", 0).otherwise(1)
    ends = [F.struct(F.col("at").alias("p"), width.alias("d")), F.struct(F.col("post").alias("p"), (-width).alias("d"))]
    events = rows.withColumn("_e", F.explode(F.array(*ends))).select("*", F.col("_e.p").alias("_p"), F.col("_e.d").alias("_d"))
    order = W.partitionBy("page_id").orderBy("_p", "_d").rowsBetween(*_UPTO)
    return events.drop("_e").withColumn("_open", F.sum("_d").over(order))


def _cut(rows: DataFrame) -> DataFrame:
    """Move `post` to where the number of open elements first falls below what
    it was: an element without an end tag does not outlast the one around it."""
    events = _events(rows)
    begins = F.col("_p") == F.col("at")
    events = events.withColumn("_height", F.when(begins, F.col("_open")).otherwise(F.col("_open") + 1))
    after = W.partitionBy("page_id", "_height").orderBy(F.desc("_p"), F.desc("_d")).rowsBetween(*_BEFORE)
    falls = F.last(F.when(F.col("_d") < 0, F.col("_p")), ignorenulls=True).over(after)
    cut = events.withColumn("post", F.when(F.col("kind") == "open", F.least("post", falls)).otherwise(F.col("post")))
    return cut.filter(begins).drop("_p", "_d", "_open", "_height")


def _with_level(rows: DataFrame) -> DataFrame:
    """Add `level`, the number of elements around one, itself included."""
    begins = _events(rows).filter(F.col("_p") == F.col("at"))
    return begins.withColumn("level", F.when(F.col("kind") == "void", F.col("_open") + 1).otherwise(F.col("_open"))).drop("_p", "_d", "_open")


def _with_family(rows: DataFrame) -> DataFrame:
    """Add `parent` (-1 for none), `before` (the sibling before), `nth` and `nth_last`."""
    seen = rows.withColumn("_l", F.explode(F.array(F.col("level"), F.col("level") - 1)))
    asks = F.col("_l") < F.col("level")
    order = W.partitionBy("page_id", "_l").orderBy("at", F.desc("_l")).rowsBetween(*_BEFORE)
    around = F.last(F.when(~asks & (F.col("kind") == "open"), F.col("at")), ignorenulls=True).over(order)
    rows = seen.withColumn("parent", F.coalesce(around, F.lit(-1))).filter(asks).drop("_l")
    family = W.partitionBy("page_id", "parent").orderBy("at")
    return rows.select(
        "*",
        F.lag("at").over(family).alias("before"),
        F.row_number().over(family).alias("nth"),
        F.row_number().over(W.partitionBy("page_id", "parent").orderBy(F.desc("at"))).alias("nth_last"),
    )


def elements(pages: DataFrame) -> DataFrame:
    """Elements of `pages(page_id, html)`: page_id, at, size, kind, tag, raw, post,
    level, parent, before, nth, nth_last.

    An element lies from `at`, the place of its opening tag of `size` characters,
    up to `post`; another one is inside it where its `at` lies between. Tags of
    one name pair up like brackets, those that may lack an end tag within their
    container; an element that has none ends where an element starts that HTML
    lets end it, or with the element around it. A stray
    end tag does nothing. An element that crosses another is cut at its end.
    """
    return _with_family(_with_level(_cut(_with_ends(_with_scope(_with_pairs(tags(deal_pages(pages))))))))
