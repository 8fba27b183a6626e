"""One outcome per crawled row: a result, or an error with its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.markup import page_title
from pagemill.functions.reuse import reuse
from pagemill.functions.text import let
from pagemill.functions.urls import path_extension, rule_message, url_parts, url_rule
from pagemill.operators.content import (
    CATEGORIES,
    MAX_BYTES,
    classify,
    document_error,
    first_bytes,
    refined_type,
    unsupported_error,
)
from pagemill.operators.guard import parts_error, redirect_error, resolved_error, with_lookups
from pagemill.operators.links import LINK_TYPE, page_links
from pagemill.operators.markdown import to_markdown
from pagemill.operators.select import select_content

UPSTREAM = "URL returned non-success status"


@reuse
def _title() -> Column:
    return page_title(F.col("html"))


@reuse
def _base() -> Column:
    return url_parts(F.col("url"))


@reuse
def _judgement(cidrs: tuple[str, ...], hosts: tuple[str, ...], cap: int, decoded: tuple[str, ...]) -> Column:
    """Struct of category, outcome, http_status, status and error.

    Both URLs are split once; every fact is computed once and then looked at.
    """
    url, final_url = F.col("url"), F.col("final_url")
    split = F.struct(url_parts(url).alias("u"), url_parts(final_url).alias("f"))
    has_text = F.coalesce(*[F.col(c) for c in decoded]).isNotNull() if decoded else F.lit(False)

    def gather(v: Column) -> Column:
        final_error = resolved_error(parts_error(v["f"], cidrs, hosts), F.col("final_url_private"))
        return F.struct(
            rule_message(url_rule(url, v["u"])).alias("issue"),
            resolved_error(parts_error(v["u"], cidrs, hosts), F.col("url_private")).alias("guard_error"),
            redirect_error(final_error, url, final_url).alias("redirect_error"),
            let(
                refined_type(F.col("content_type"), path_extension(v["u"]), F.col("_head")),
                lambda m: F.struct(m.alias("name"), classify(m).alias("category")),
            ).alias("media"),
            F.col("fetch_error").alias("fetch_error"),
            F.coalesce("status", F.lit(0)).alias("status"),
            F.col("_size").alias("size"),
            has_text.alias("has_text"),
        )

    def judge(f: Column) -> Column:
        category, status = f["media"]["category"], f["status"]
        is_html = category == "html"
        document = document_error(category, status, f["size"], cap)
        label = F.when(is_html, F.lit("Failed to fetch URL: ")).otherwise(
            F.concat(F.lit("Failed to process "), F.upper(category), F.lit(": "))
        )

        def verdict(outcome: str, sent, error: Column | None, kept=None) -> Column:
            sent = F.lit(sent) if not isinstance(sent, Column) else sent
            return F.struct(
                category.alias("category"),
                F.lit(outcome).alias("outcome"),
                sent.cast("int").alias("http_status"),
                (sent if kept is None else kept).cast("int").alias("status"),
                (F.lit(None) if error is None else error).cast("string").alias("error"),
            )

        return (
            F.when(f["issue"].isNotNull(), verdict("invalid_url", 422, f["issue"]))
            .when(f["guard_error"].isNotNull(), verdict("blocked", 403, f["guard_error"]))
            .when(f["redirect_error"].isNotNull(), verdict("blocked_redirect", 403, f["redirect_error"]))
            .when(category == "unsupported", verdict("unsupported", 415, unsupported_error(f["media"]["name"])))
            .when(f["fetch_error"].isNotNull(), verdict("fetch_failed", 502, F.concat(label, f["fetch_error"])))
            .when(~is_html & document.isNotNull(), verdict("document_failed", 502, document))
            .when(~is_html & ~f["has_text"], verdict("needs_decoder", None, None))
            .when(
                is_html & ((status >= 400) | (status == 0)),
                verdict("upstream_status", F.when(status == 0, 502).otherwise(status), F.lit(UPSTREAM), status),
            )
            .otherwise(verdict("ok", 200, None))
        )

    return let(let(split, gather), judge)


def outcomes(
    crawl: DataFrame,
    cidrs: tuple[str, ...] = (),
    hosts: tuple[str, ...] = (),
    dns: DataFrame | None = None,
    cap: int = MAX_BYTES,
) -> DataFrame:
    """Add category, outcome, http_status, status and error; the first failing
    check wins. A status 0 is sent as 502 and kept as 0 in `status`.

    A document row counts as done when the caller joined decoded text on, as
    column `decoded_html` or `decoded_markdown`; otherwise it needs a decoder.
    """
    decoded = tuple(c for c in ("decoded_html", "decoded_markdown") if c in crawl.columns)
    cidrs, hosts = tuple(cidrs), tuple(hosts)
    # Of a body only its size and first bytes are looked at; they are taken in the
    # scan, so that no body meets the look-ups unless the caller wants it after.
    narrow = crawl.withColumn("_size", F.octet_length("body")).withColumn("_head", first_bytes(F.col("body")))
    rows = with_lookups(narrow, dns, ("url", "final_url"), cidrs, hosts)
    kept = [c for c in crawl.columns if c != "status"]
    return rows.select(*kept, _judgement(cidrs, hosts, cap, decoded).alias("_verdict")).select(*kept, "_verdict.*")


def page_errors(judged: DataFrame) -> DataFrame:
    """(page_id, url, error, status, http_status) of every rejected row."""
    return judged.filter(F.col("error").isNotNull()).select("page_id", "url", "error", "status", "http_status")


def page_results(judged: DataFrame) -> DataFrame:
    """(page_id, category, url, title, markdown, links) of every row with
    outcome `ok`.

    HTML rows answer with their final URL, documents with the requested one,
    without title and links. With a `selector` column, rows that name one give
    the first matching element instead of the main content.
    """
    done = judged.filter(F.col("outcome") == "ok")
    carry = ("url", "doc_title", "links")
    pages = done.filter(F.col("category") == "html").withColumn("url", F.coalesce("final_url", "url"))
    wanted = ["page_id", "url", "html"] + (["selector"] if "selector" in judged.columns else [])
    pages = page_links(pages.select(*wanted).withColumn("doc_title", _title()), "url")

    def finish(rows: DataFrame, title: Column) -> DataFrame:
        return rows.select(
            "page_id",
            F.lit("html").alias("category"),
            F.col("page.url").alias("url"),
            title.alias("title"),
            "markdown",
            F.col("page.links").alias("links"),
        )

    read = pages.filter(F.col("selector").isNull()) if "selector" in judged.columns else pages
    out = finish(
        to_markdown(read, base=_base(), carry=carry),
        F.coalesce("article_title", "page.doc_title"),
    )
    if "selector" in judged.columns:
        chosen = pages.filter(F.col("selector").isNotNull())
        content = select_content(chosen.select("page_id", "html", "selector")).select(
            "page_id", F.col("content").alias("html")
        )
        cut = chosen.drop("html").join(content, "page_id")
        out = out.unionByName(
            finish(to_markdown(cut, carry=carry, main_content=False), F.col("page.doc_title"))
        )
    documents = done.filter(F.col("category") != "html")
    no_links = F.array().cast(LINK_TYPE)
    if "decoded_markdown" in judged.columns:
        written = documents.filter(F.col("decoded_markdown").isNotNull())
        out = out.unionByName(
            written.select(
                "page_id", "category", "url", F.lit(None).cast("string").alias("title"),
                F.col("decoded_markdown").alias("markdown"), no_links.alias("links"),
            )
        )
    if "decoded_html" in judged.columns:
        rest = documents
        if "decoded_markdown" in judged.columns:
            rest = rest.filter(F.col("decoded_markdown").isNull())
        rest = rest.select("page_id", "category", "url", F.col("decoded_html").alias("html"))
        text = to_markdown(rest, carry=("category", "url"), main_content=False)
        out = out.unionByName(
            text.select(
                "page_id", "page.category", "page.url", F.lit(None).cast("string").alias("title"),
                "markdown", no_links.alias("links"),
            )
        )
    return out


def page_metrics(results: DataFrame) -> DataFrame:
    return results.select(
        "page_id",
        "url",
        F.length("markdown").alias("markdown_length"),
        F.size("links").alias("links_count"),
    )


def run_summary(judged: DataFrame, results: DataFrame) -> DataFrame:
    """Rows, lengths and links per category and outcome. Rejected rows are read
    without their pages; nothing is joined."""
    none = F.lit(None).cast("int")
    failed = judged.filter(F.col("outcome") != "ok").select(
        "category", "outcome", "http_status", none.alias("markdown_length"), none.alias("links_count")
    )
    done = results.select(
        "category",
        F.lit("ok").alias("outcome"),
        F.lit(200).alias("http_status"),
        F.length("markdown").alias("markdown_length"),
        F.size("links").alias("links_count"),
    )
    return failed.unionByName(done).groupBy("category", "outcome", "http_status").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("markdown_length").alias("total_markdown_length"),
        F.avg("markdown_length").alias("mean_markdown_length"),
        F.sum("links_count").alias("total_links"),
    )


def summary_figures() -> list[Column]:
    """What an Observation of results gathers: rows, lengths and links per category, in one pass and without a shuffle."""
    out = []
    for category in CATEGORIES:
        own = F.col("category") == category
        out += [
            F.count_if(own).alias(f"{category}_rows"),
            F.sum(F.when(own, F.length("markdown"))).alias(f"{category}_length"),
            F.count(F.when(own, F.col("markdown"))).alias(f"{category}_written"),
            F.sum(F.when(own, F.size("links"))).alias(f"{category}_links"),
        ]
    return out


def observed_summary(spark: SparkSession, seen: Observation) -> DataFrame:
    """The `ok` rows of `run_summary`, from what the write of the results has seen; waits for that write."""
    got, rows = seen.get, []
    for category in CATEGORIES:
        n, length, written, links = (got[f"{category}_{name}"] for name in ("rows", "length", "written", "links"))
        if n:
            rows.append((category, "ok", 200, n, length, length / written if written else None, links))
    return spark.createDataFrame(
        rows,
        "category string, outcome string, http_status int, n_rows long, total_markdown_length long, "
        "mean_markdown_length double, total_links long",
    )
