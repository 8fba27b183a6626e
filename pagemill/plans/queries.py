"""One query per operator, over the given tables or fixtures derived from them.

Results are flat: lists are written as text, so that any engine can check them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import addresses, idna, urls
from pagemill.functions.markup import page_title
from pagemill.functions.text import comma_list, decode_entities, flag_word
from pagemill.operators import blocks, content, guard, limits, links, markdown, outcomes, select, tokens
from pagemill.operators.layout import working_folder
from pagemill.plans.fixtures import spark_fixture
from pagemill.sources import documents, pages
from pagemill.streaming import block_stream, page_stream, request_stream

# Policy of the limit queries: events are spread thinly, so windows are long.
REQUESTS, DURATION, BLOCK, DELAY = 5, "1 day", "12 hours", "1 hour"
# Size limits small enough for the test texts to cross them.
INTAKE_CAP, BODY_CAP = 4096, 3000

QUERIES = {}


def query(fn, name: str | None = None):
    QUERIES[name or fn.__name__] = fn
    return fn


def named(name: str):
    """For queries whose name is that of the function they call."""
    return lambda fn: query(fn, name)


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.read_pages(spark, f"{sf}/pages.parquet")


def _crawl(spark: SparkSession, sf: str) -> DataFrame:
    return spark_fixture(spark, sf, "crawl_x")


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes.outcomes(
        _crawl(spark, sf), cidrs=("10.0.0.0/26",), dns=spark_fixture(spark, sf, "dns_x"), cap=BODY_CAP
    )


def _link_text(column: str = "links") -> Column:
    return F.array_join(
        F.transform(column, lambda x: F.concat_ws(" ", x["url"], x["text"], F.coalesce(x["rel"], F.lit("-")))), "\n"
    )


# -- scans and sinks ---------------------------------------------------------


@query
def scan_pages(spark, sf):
    return pages.as_crawl(_pages(spark, sf)).select(
        "page_id", "url", "final_url", "status", "content_type", F.length("html").alias("html_length")
    )


@query
def doc_intake(spark, sf):
    files = spark_fixture(spark, sf, "file_x")
    return documents.doc_intake(documents.heads(files, INTAKE_CAP), INTAKE_CAP)


@query
def page_errors(spark, sf):
    return outcomes.page_errors(_judged(spark, sf))


@query
def stream_pages(spark, sf):
    def job(batch):
        return outcomes.page_metrics(outcomes.page_results(outcomes.outcomes(pages.as_crawl(batch))))

    target, checkpoint = working_folder(spark, "pages"), working_folder(spark, "pages-checkpoint")
    page_stream.stream_pages(spark, f"{sf}/pages.parquet*", pages.PAGE_SCHEMA, job, target, checkpoint, max_files=64)
    return spark.read.parquet(target).drop("batch")


# -- projections and filters -------------------------------------------------


@query
def validate_url(spark, sf):
    rows = spark_fixture(spark, sf, "url_x").select("id", urls.url_issues(F.col("url")).alias("issues"))
    first = F.try_element_at("issues", F.lit(1))
    return rows.select(
        "id",
        F.size("issues").alias("n_issues"),
        first["field"].alias("field"),
        first["rule"].alias("rule"),
        first["message"].alias("message"),
    )


@query
def guard_protocol(spark, sf):
    error = guard.protocol_error(urls.url_parts(F.col("url")))
    return spark_fixture(spark, sf, "url_x").select("id", error.alias("error"))


@query
def guard_invalid(spark, sf):
    error = F.when(~urls.is_parsable(urls.url_parts(F.col("url"))), F.lit(guard.INVALID))
    return spark_fixture(spark, sf, "url_x").select("id", error.alias("error"))


def _address(spark, sf, test, name):
    return spark_fixture(spark, sf, "addr_x").select("id", "addr", test(F.col("addr")).alias(name))


@query
def private_ipv4(spark, sf):
    return _address(spark, sf, addresses.is_private_ipv4, "private")


@query
def private_ipv6(spark, sf):
    return _address(spark, sf, addresses.is_private_ipv6, "private")


@query
def is_ip_literal(spark, sf):
    return _address(spark, sf, addresses.is_ip_literal, "literal")


@query
def ip_to_int(spark, sf):
    return _address(spark, sf, addresses.ip_to_int, "value")


@query
def ip_canonical(spark, sf):
    host = F.split_part(F.split_part(F.col("url"), F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    rows = spark_fixture(spark, sf, "url_x").select("id", host.alias("host"))
    return rows.select("id", "host", addresses.canonical_ipv4(F.col("host")).alias("quad"))


@query
def classify_content_type(spark, sf):
    return _crawl(spark, sf).select(
        "page_id", "content_type", content.classify(F.col("content_type")).alias("category")
    )


@query
def url_extension(spark, sf):
    return spark_fixture(spark, sf, "url_x").select("id", urls.url_extension(F.col("url")).alias("extension"))


@query
def refine_by_extension(spark, sf):
    return _crawl(spark, sf).select(
        "page_id", content.refine_by_extension(F.col("content_type"), urls.url_extension(F.col("url"))).alias("media_type")
    )


@query
def refine_by_magic(spark, sf):
    return _crawl(spark, sf).select(
        "page_id", content.refine_by_magic(F.col("content_type"), F.col("body")).alias("media_type")
    )


@query
def resolve_kind(spark, sf):
    return spark_fixture(spark, sf, "file_x").select(
        "path", content.resolve_kind(F.col("path"), F.col("content")).alias("kind")
    )


@query
def intake_limits(spark, sf):
    path, length = F.col("path"), F.col("length")
    return spark_fixture(spark, sf, "file_x").select(
        "path",
        "length",
        content.intake_status(path, length, INTAKE_CAP).alias("status"),
        content.intake_error(path, length, INTAKE_CAP).alias("error"),
    )


def _documents(spark, sf):
    rows = _crawl(spark, sf).select(
        "page_id",
        "status",
        F.octet_length("body").alias("size"),
        content.classify(
            content.refined_type(F.col("content_type"), urls.url_extension(F.col("url")), F.col("body"))
        ).alias("category"),
    )
    return rows.filter(F.col("category").isin("pdf", "docx"))


@query
def body_size_cap(spark, sf):
    error = content.document_error(F.col("category"), F.lit(200), F.col("size"), BODY_CAP)
    return _documents(spark, sf).select("page_id", "category", "size", error.alias("error"))


@query
def document_status(spark, sf):
    error = content.document_error(F.col("category"), F.col("status"), F.lit(0), BODY_CAP)
    return _documents(spark, sf).select("page_id", "category", "status", error.alias("error"))


@query
def status_filter(spark, sf):
    crawl = _crawl(spark, sf)
    rows = pages.as_crawl(crawl, status=F.col("status"))
    return (
        outcomes.outcomes(rows)
        .filter(F.col("outcome") == "upstream_status")
        .select("page_id", "http_status", "status", "error")
    )


@query
def unsupported_type(spark, sf):
    kind = F.col("content_type")
    return (
        _crawl(spark, sf)
        .filter(content.classify(kind) == "unsupported")
        .select("page_id", content.unsupported_error(kind).alias("error"))
    )


@query
def href_filter(spark, sf):
    return spark_fixture(spark, sf, "href_x").select("id", "href", links.href_wanted(F.col("href")).alias("wanted"))


@query
def same_host_links(spark, sf):
    rows = spark_fixture(spark, sf, "href_x").withColumn("_base", urls.url_parts(F.col("base")))
    rows = rows.filter(links.href_wanted(F.col("href"))).select(
        "id", links.resolve_same_host(F.col("_base"), F.col("href")).alias("url")
    )
    return rows.filter(F.col("url").isNotNull())


@query
def page_results(spark, sf):
    rows = outcomes.page_results(_judged(spark, sf))
    return rows.select("page_id", "url", "title", "markdown", _link_text().alias("links"))


@query
def fetch_failures(spark, sf):
    return (
        _judged(spark, sf)
        .filter(F.col("outcome") == "fetch_failed")
        .select("page_id", "http_status", "status", "error")
    )


# -- joins -------------------------------------------------------------------


@query
def host_allow_join(spark, sf):
    rows = guard.allow_hosts(spark_fixture(spark, sf, "url_x"), spark_fixture(spark, sf, "allowed_host"))
    return rows.select("id", "host", "host_allowed", "guard_error")


@query
def parse_cidr(spark, sf):
    return guard.parse_cidrs(spark_fixture(spark, sf, "cidr_x"))


@query
def cidr_allow_join(spark, sf):
    return guard.address_verdicts(spark_fixture(spark, sf, "addr_x"), spark_fixture(spark, sf, "cidr_x"))


@query
def dns_guard(spark, sf):
    rows = guard.guard(
        _pages(spark, sf).select("page_id", "url"), dns=spark_fixture(spark, sf, "dns_x"), final_url=None
    )
    return rows.select("page_id", "url", "guard_error")


@query
def redirect_guard(spark, sf):
    rows = guard.guard(
        _crawl(spark, sf).select("page_id", "url", "final_url"), dns=spark_fixture(spark, sf, "dns_x")
    )
    return rows.filter("redirect_error IS NOT NULL").select("page_id", "final_url", "redirect_error")


@query
def select_content(spark, sf):
    return select.select_content(spark_fixture(spark, sf, "select_x"))


@query
def select_structure(spark, sf):
    return select.select_content(spark_fixture(spark, sf, "structure_x"))


@query
def crawl_frontier(spark, sf):
    everything = _pages(spark, sf)
    return links.crawl_frontier(everything, everything.filter(F.col("page_id") % 2 == 0))


def _log(spark, sf):
    return spark_fixture(spark, sf, "request_log")


@query
def blocked_requests(spark, sf):
    log = _log(spark, sf)
    return limits.blocked_requests(log, limits.block_intervals(log, REQUESTS, DURATION, BLOCK), BLOCK)


# -- aggregations ------------------------------------------------------------


@query
def page_metrics(spark, sf):
    judged = outcomes.outcomes(pages.as_crawl(_pages(spark, sf)))
    return outcomes.page_metrics(outcomes.page_results(judged))


@query
def run_summary(spark, sf):
    judged = _judged(spark, sf)
    return outcomes.run_summary(judged, outcomes.page_results(judged))


@query
def request_counts(spark, sf):
    return limits.request_counts(_log(spark, sf), DURATION)


@query
def page_links(spark, sf):
    rows = links.page_links(_pages(spark, sf))
    return rows.select("page_id", F.size("links").alias("n_links"), _link_text().alias("links"))


@query
def host_link_counts(spark, sf):
    return links.host_link_counts(_pages(spark, sf))


@query
def page_markdown(spark, sf):
    rows = markdown.to_markdown(_pages(spark, sf), base=urls.url_parts(F.col("url")))
    return rows.select("page_id", "markdown")


# -- windows -----------------------------------------------------------------


@query
def token_blocks(spark, sf):
    return tokens.with_blocks(tokens.tokens(_pages(spark, sf))).select("page_id", "pos", "kind", "tag", "block_id")


@query
def token_depth(spark, sf):
    rows = tokens.with_depth(tokens.tokens(spark_fixture(spark, sf, "html_list_x")))
    return rows.select("page_id", "pos", "list_depth", "quote_depth")


def _numbered(rows: DataFrame) -> DataFrame:
    """Blocks that show something, counted from 1 in page order."""
    order = W.partitionBy("page_id").orderBy("block_id")
    return rows.withColumn("block_no", F.row_number().over(order))


def _in_all_scripts(spark, sf) -> DataFrame:
    """The given pages, and as many in scripts without spaces."""
    return _pages(spark, sf).select("page_id", "html").unionByName(spark_fixture(spark, sf, "unspaced_x"))


@query
def block_features(spark, sf):
    rows = blocks.page_blocks(_in_all_scripts(spark, sf)).filter("shows")
    return _numbered(rows).select("page_id", "block_no", "words", "link_words")


@query
def main_content_blocks(spark, sf):
    rows = blocks.with_keep(blocks.page_blocks(_in_all_scripts(spark, sf))).filter("shows")
    return _numbered(rows).select("page_id", "block_no", F.col("main").alias("keep"))


@query
def content_fallback(spark, sf):
    """The given pages, and for each a copy made of its links alone."""
    real = _pages(spark, sf).select("page_id", "html")
    bare = real.select(
        (-1 - F.col("page_id")).alias("page_id"), F.regexp_extract("html", "<nav>.*</nav>", 0).alias("html")
    )
    rows = blocks.with_keep(blocks.page_blocks(real.unionByName(bare))).filter("shows")
    return rows.groupBy("page_id").agg(
        F.max("fallback").alias("fallback"),
        F.count_if("keep").alias("n_kept"),
        F.count(F.lit(1)).alias("n_blocks"),
    )


@query
def list_items(spark, sf):
    rows = blocks.with_structure(blocks.page_blocks(spark_fixture(spark, sf, "html_list_x")))
    return _numbered(rows.filter("leads_item")).select(
        "page_id", F.col("block_no").alias("item_no"), "number", "list_depth", "text"
    )


@query
def over_limit_requests(spark, sf):
    return limits.over_limit_requests(_log(spark, sf), REQUESTS, DURATION)


@query
def top_targets(spark, sf):
    return links.top_targets(_pages(spark, sf), 3)


@query
def page_outcomes(spark, sf):
    return _judged(spark, sf).select("page_id", "category", "outcome", "http_status", "status", "error")


# -- scalar functions --------------------------------------------------------


@query
def url_parts(spark, sf):
    rows = spark_fixture(spark, sf, "url_x").select("id", urls.url_parts(F.col("url")).alias("p"))
    return rows.select("id", "p.*")


@query
def resolve_href(spark, sf):
    rows = spark_fixture(spark, sf, "href_x").withColumn("_base", urls.url_parts(F.col("base")))
    return rows.select("id", urls.resolve_href(F.col("_base"), F.col("href")).alias("url"))


@query
def ascii_host(spark, sf):
    rows = spark_fixture(spark, sf, "host_x")
    return rows.select("id", idna.ascii_host(F.lower("host")).alias("host"))


@query
def normalize_url(spark, sf):
    return spark_fixture(spark, sf, "url_x").select("id", urls.normalize_url(F.col("url")).alias("url"))


@query
def flag_words(spark, sf):
    return spark_fixture(spark, sf, "flag_x").select("id", flag_word(F.col("flag")).alias("flag"))


@named("comma_list")
def comma_list_items(spark, sf):
    items = comma_list(F.col("list"))
    return spark_fixture(spark, sf, "flag_x").select(
        "id", F.size(items).alias("n_items"), F.array_join(items, "|").alias("items")
    )


@named("page_title")
def page_title_text(spark, sf):
    return _pages(spark, sf).select("page_id", page_title(F.col("html")).alias("title"))


@query
def anchor_fields(spark, sf):
    rows = spark_fixture(spark, sf, "anchor_x").select(
        "page_id", F.posexplode(links.anchors(F.col("html"))).alias("anchor_no", "a")
    )
    return rows.select("page_id", "anchor_no", "a.href", "a.text", "a.rel")


@named("decode_entities")
def entity_text(spark, sf):
    return spark_fixture(spark, sf, "html_mix_x").select("page_id", decode_entities(F.col("html")).alias("text"))


@query
def article_title(spark, sf):
    rows = _pages(spark, sf).withColumn("doc_title", page_title(F.col("html")))
    made = markdown.to_markdown(rows, carry=("doc_title",))
    return made.select("page_id", F.coalesce("article_title", "page.doc_title").alias("title"))


# -- Markdown rules ----------------------------------------------------------


def _block_texts(spark, sf, fixture: str) -> DataFrame:
    """(page_id, block_no, tag, opened, md) of every block with text."""
    rows = blocks.with_structure(blocks.page_blocks(spark_fixture(spark, sf, fixture)))
    rows = rows.filter(F.col("shows") & (F.col("text") != ""))
    return _numbered(rows).select(
        "page_id",
        "block_no",
        "tag",
        (~F.col("closing")).alias("opened"),
        markdown.block_markdown().alias("md"),
        "list_depth",
        "number",
        "leads_item",
        "quote_depth",
    )


# name -> fixture and the blocks that show the rule
MD_RULES = {
    "md_headings": ("html_mix_x", "opened AND tag IN ('h1','h2','h3','h4','h5','h6')"),
    "md_breaks": ("html_mix_x", "md LIKE concat('%  ', chr(10), '%')"),
    "md_bullets": ("html_list_x", "leads_item AND number IS NULL"),
    "md_numbers": ("html_list_x", "leads_item AND number IS NOT NULL"),
    "md_code_blocks": ("html_mix_x", "opened AND tag = 'pre'"),
    "md_inline_code": ("html_mix_x", "md LIKE '%`%'"),
    "md_emphasis": ("html_mix_x", "md LIKE '%**%' OR md LIKE '%=_%' ESCAPE '='"),
    "md_links": ("html_mix_x", "md LIKE '%](%'"),
    "md_images": ("html_mix_x", "md LIKE '%![%'"),
    "md_rules": ("html_mix_x", "md LIKE '* * *%'"),
    "md_quotes": ("html_mix_x", "quote_depth > 0"),
    "md_tables": ("html_table_x", "md LIKE '%|%'"),
    "md_strike": ("html_mix_x", "md LIKE '%~~%'"),
    "md_tasks": ("html_list_x", "md LIKE '%[x] %' OR md LIKE '%[ ] %'"),
    "md_escape": ("html_mix_x", "instr(md, chr(92)) > 0"),
    "md_whitespace": ("html_mix_x", "NOT (opened AND tag = 'pre')"),
}


def _rule(name: str):
    fixture, test = MD_RULES[name]

    def run(spark, sf):
        return _block_texts(spark, sf, fixture).filter(test).select("page_id", "block_no", "md")

    return run


for _name in MD_RULES:
    QUERIES[_name] = _rule(_name)


@query
def md_paragraphs(spark, sf):
    rows = markdown.to_markdown(spark_fixture(spark, sf, "html_mix_x"), main_content=False)
    return rows.select("page_id", "markdown")


@query
def md_dropped(spark, sf):
    """What remains of each page as words once hidden parts are gone."""
    rows = markdown.to_markdown(
        spark_fixture(spark, sf, "html_mix_x"), main_content=False
    )
    return rows.select(
        "page_id",
        F.length("markdown").alias("n_chars"),
        F.col("markdown").rlike("<script|<style|<!--|track\\(|margin:").alias("leaks"),
    )


# -- streams -----------------------------------------------------------------


def _log_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )


@query
def stream_request_counts(spark, sf):
    target = request_stream.run_counts(
        spark, _log_stream(spark, sf), DURATION, DELAY, working_folder(spark, "counts"), working_folder(spark, "counts-checkpoint")
    )
    return spark.read.parquet(target).select(
        "key", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n_requests"
    )


@query
def block_intervals(spark, sf):
    return limits.block_intervals(_log(spark, sf), REQUESTS, DURATION, BLOCK)


@query
def stream_block_intervals(spark, sf):
    target = block_stream.run_blocks(
        spark, _log_stream(spark, sf), REQUESTS, DURATION, BLOCK, DELAY, working_folder(spark, "blocks"), working_folder(spark, "blocks-checkpoint")
    )
    return spark.read.parquet(target).select(
        "key", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("blocked_from", "blocked_until")]
    )
