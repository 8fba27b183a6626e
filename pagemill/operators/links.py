"""Links of a page, and tables over many pages' links.

The links of one page are read inside the scan; nothing is shuffled for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.markup import ANCHOR_REGEX, ANCHOR_TAG, plain_text, raw_attribute
from pagemill.functions.reuse import reuse
from pagemill.functions.text import decode_entities, let, web_trim
from pagemill.functions.urls import is_parsable, render_url, resolve_text, url_parts

# How an href starts that names no other page.
SKIPPED_PREFIXES = ("#", "javascript:", "data:", "vbscript:", "mailto:")

LINK_TYPE = "array<struct<url:string,text:string,rel:string>>"


def href_wanted(href: Column) -> Column:
    lowered = F.lower(web_trim(href))

    def test(h: Column) -> Column:
        keep = h != ""
        for prefix in SKIPPED_PREFIXES:
            keep = keep & ~h.startswith(prefix)
        return keep

    return F.coalesce(let(lowered, test), F.lit(False))


def anchors(html: Column) -> Column:
    """Array of {href, text, rel} for every `a[href]`, in page order."""
    tag = rf"(?is)^{ANCHOR_TAG}"
    found = F.filter(F.regexp_extract_all(html, F.lit(ANCHOR_REGEX), F.lit(0)), lambda m: m.rlike(tag))

    def fields(anchor: Column) -> Column:
        values = F.transform(
            F.array(raw_attribute(anchor, "href"), raw_attribute(anchor, "rel")),
            lambda v: decode_entities(v, in_attribute=True),
        )
        return let(
            values,
            lambda v: F.struct(
                v[0].alias("href"),
                web_trim(plain_text(F.regexp_replace(anchor, tag, ""))).alias("text"),
                F.nullif(v[1], F.lit("")).alias("rel"),
            ),
        )

    return F.filter(F.transform(found, fields), lambda a: a["href"].isNotNull())


def resolve_same_host(base: Column, href: Column) -> Column:
    """Normal URL of `href` where it stays on the host of `base`, else null.
    Scheme and port do not matter."""
    return let(
        url_parts(resolve_text(base, href)),
        lambda p: F.when(is_parsable(p) & (p["host"] == base["host"]), render_url(p)),
    )


@reuse
def _links(html: str, base: str) -> Column:
    wanted = F.filter(anchors(F.col(html)), lambda a: href_wanted(a["href"]))
    resolved = F.transform(
        wanted,
        lambda a: F.struct(
            resolve_same_host(F.col(base), a["href"]).alias("url"), a["text"].alias("text"), a["rel"].alias("rel")
        ),
    )
    return F.filter(resolved, lambda link: link["url"].isNotNull())


@reuse
def _base(url: str) -> Column:
    return url_parts(F.col(url))


def page_links(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add `links`: same-host links over the whole page, in document order,
    duplicates kept. `url` names the column with the final URL of the page."""
    return (
        pages.withColumn("_base", _base(url))
        .withColumn("links", F.coalesce(_links("html", "_base"), F.array().cast(LINK_TYPE)))
        .drop("_base")
    )


def link_rows(pages: DataFrame, url: str = "url") -> DataFrame:
    """One row per link: page_id, source host, link_no, url, text, rel."""
    found = page_links(pages, url).select(
        "page_id", _base(url)["host"].alias("host"), F.posexplode_outer("links").alias("link_no", "link")
    )
    # The outer form: the plain one would have Spark read the links of every
    # page twice, first in a filter for pages without any.
    return found.filter(F.col("link").isNotNull()).select("page_id", "host", "link_no", "link.url", "link.text", "link.rel")


def crawl_frontier(pages: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Same-host links not crawled yet: (url, n_pages).

    A page names each target once, so counting rows counts pages, and the counts
    combine before the shuffle. The join key is then unique on both sides.
    """

    def bare(link: Column) -> Column:
        return F.regexp_replace(link, "#.*$", "")

    targets = F.array_distinct(F.transform("links", lambda x: bare(x["url"])))
    named = page_links(pages, url).select(F.explode_outer(targets).alias("url")).filter("url IS NOT NULL")
    counted = named.groupBy("url").agg(F.count(F.lit(1)).alias("n_pages"))
    return counted.join(seen.select(bare(F.col("url")).alias("url")).distinct(), "url", "left_anti")


def host_link_counts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Links per source host and target path: n_links, n_pages.

    Each page gives one row per link and one more per distinct target, so both
    figures are sums over one shuffle and combine before it; a target that most
    pages name reaches its task as one row per map task.
    """
    paths = F.transform("links", lambda x: F.regexp_extract(x["url"], "^[a-z]+://[^/?#]*([^?#]*)", 1))

    def emit(path: Column, links: int, pages_: int) -> Column:
        return F.struct(path.alias("target"), F.lit(links).alias("links"), F.lit(pages_).alias("pages"))

    counted = let(
        paths,
        lambda p: F.concat(
            F.transform(p, lambda x: emit(x, 1, 0)), F.transform(F.array_distinct(p), lambda x: emit(x, 0, 1))
        ),
    )
    rows = page_links(pages, url).select(_base(url)["host"].alias("host"), F.explode_outer(counted).alias("x"))
    return (
        rows.filter("x IS NOT NULL")
        .groupBy("host", F.col("x.target").alias("target"))
        .agg(F.sum("x.links").alias("n_links"), F.sum("x.pages").alias("n_pages"))
    )


def top_targets(pages: DataFrame, k: int = 3, url: str = "url") -> DataFrame:
    """The k most linked targets of each host, ties broken by target text."""
    counts = host_link_counts(pages, url)
    best = W.partitionBy("host").orderBy(F.desc("n_links"), F.desc("n_pages"), "target")
    return counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
