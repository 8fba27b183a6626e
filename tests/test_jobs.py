"""Whole jobs: outcomes, sinks, streams, intake and the shape of the plans."""

import re

from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagemill import api
from pagemill.functions.urls import url_parts
from pagemill.operators import guard, outcomes
from pagemill.operators.markdown import to_markdown
from pagemill.plans.fixtures import spark_fixture
from pagemill.plans.queries import QUERIES
from pagemill.sources import documents, pages
from pagemill.streaming import page_stream


def crawl(spark, rows):
    filled = [
        (i, r.get("url"), r.get("final_url", r.get("url")), r.get("status", 200), r.get("type", "text/html"),
         r.get("html"), r.get("body"), r.get("fetch_error"), r.get("selector"), r.get("decoded_html"), r.get("decoded_markdown"))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(
        filled, pages.CRAWL_SCHEMA + ", selector STRING, decoded_html STRING, decoded_markdown STRING"
    )


LONG = "word " * 30
ROWS = [
    {"url": None},
    {"url": "not-a-url"},
    {"url": "file:///etc/passwd"},
    {"url": "http://127.0.0.1/admin"},
    {"url": "http://h.org/", "final_url": "http://10.0.0.1/"},
    {"url": "http://h.org/", "type": "Image/PNG; a=b"},
    {"url": "http://h.org/", "fetch_error": "getaddrinfo ENOTFOUND"},
    {"url": "http://h.org/x.pdf", "type": "application/pdf", "status": 404},
    {"url": "http://h.org/x.pdf", "type": "application/pdf", "body": bytearray(b"%PDF-" + b"x" * 100)},
    {"url": "http://h.org/x.docx", "type": "application/octet-stream", "body": bytearray(b"PK")},
    {"url": "http://h.org/", "status": 404},
    {"url": "http://h.org/", "status": 0},
    {"url": "http://h.org/", "final_url": "http://h.org/moved", "html": f"<title>D</title><h1>H</h1><p>{LONG}<a href=/a rel=x>A</a>"},
    {"url": "http://h.org/", "html": f"<title>D</title><h1>H</h1><div class=c>chosen <b>part</b></div><p>{LONG}", "selector": ".c"},
    {"url": "http://h.org/y.docx", "type": "application/octet-stream", "body": bytearray(b"PK"), "decoded_html": "<p>from <i>docx</i></p>"},
    {"url": "http://h.org/y.pdf", "type": "application/pdf", "body": bytearray(b"%PDF-"), "decoded_markdown": "# pdf"},
]
OUTCOMES = [
    ("invalid_url", 422, 422), ("invalid_url", 422, 422), ("invalid_url", 422, 422), ("blocked", 403, 403),
    ("blocked_redirect", 403, 403), ("unsupported", 415, 415), ("fetch_failed", 502, 502), ("document_failed", 502, 502),
    ("document_failed", 502, 502), ("needs_decoder", None, None), ("upstream_status", 404, 404), ("upstream_status", 502, 0),
    ("ok", 200, 200), ("ok", 200, 200), ("ok", 200, 200), ("ok", 200, 200),
]


def test_outcomes_results_and_sinks(spark, tmp_path):
    judged = api.outcomes(crawl(spark, ROWS), cap=50).cache()
    got = judged.orderBy("page_id").collect()
    assert [(r.outcome, r.http_status, r.status) for r in got] == OUTCOMES
    assert got[5].error == "Unsupported content type: Image/PNG"
    assert got[6].error == "Failed to fetch URL: getaddrinfo ENOTFOUND"
    assert got[7].error == "Failed to process PDF: PDF fetch failed with status 404"
    assert got[8].error == "Failed to process PDF: PDF too large: 105 bytes (max 50)"
    results = api.page_results(judged)
    rows = {r.page_id: r for r in results.collect()}
    assert rows[12].url == "http://h.org/moved" and rows[12].title == "H"
    assert [tuple(x) for x in rows[12].links] == [("http://h.org/a", "A", "x")]
    assert rows[13].markdown == "chosen **part**" and rows[13].title == "D"
    assert rows[14].markdown == "from _docx_" and rows[14].title is None and rows[14].links == []
    assert rows[15].markdown == "# pdf" and rows[15].url == "http://h.org/y.pdf"

    pages.write_results(results, str(tmp_path / "results"))
    pages.write_errors(api.page_errors(judged), str(tmp_path / "errors"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 4
    errors = spark.read.parquet(str(tmp_path / "errors"))
    assert {r.http_status: r["count"] for r in errors.groupBy("http_status").count().collect()} == {
        422: 3, 403: 2, 415: 1, 502: 4, 404: 1,
    }
    pages.write_results(results, str(tmp_path / "json"), fmt="json")
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    judged.unpersist()


def test_document_intake(spark, tmp_path):
    for name, body in {
        "a.pdf": b"%PDF-1.4", "b.PDF": b"%PDF-1.4", "c.pdf": b"plain", "d.docx": b"anything", "e.txt": b"x", "f.txt": b"x" * 60, "g": b"y",
    }.items():
        (tmp_path / name).write_bytes(body)
    got = {r.url: (r.kind, r.status) for r in documents.doc_intake(documents.read_files(spark, str(tmp_path), 50), cap=50).collect()}
    assert got == {
        "a.pdf": ("pdf", None), "b.PDF": ("pdf", None), "c.pdf": (None, 415), "d.docx": ("docx", None),
        "e.txt": (None, 415), "f.txt": (None, 413), "g": (None, 415),
    }


def test_files_of_zero_bytes(spark, tmp_path):
    source = tmp_path / "in"
    for folder in ("", "deep/er", "_hidden"):
        (source / folder).mkdir(parents=True, exist_ok=True)
    for name, body in {
        "empty.pdf": b"", "full.pdf": b"%PDF-1.4", "deep/empty.docx": b"", "deep/er/none": b"", "deep/er/a b.pdf": b"", ".hid.pdf": b"",
        "_hidden/x.pdf": b"",
    }.items():
        (source / name).write_bytes(body)
    for place in (str(source), f"file://{source}"):
        files = documents.read_files(spark, place, 50)
        got = {r.url: (r.length, r.kind, r.status, r.error) for r in documents.doc_intake(files, cap=50).collect()}
        assert files.count() == 5
        assert got == {
            "empty.pdf": (0, None, 415, "File type mismatch"), "full.pdf": (8, "pdf", None, None), "empty.docx": (0, "docx", None, None),
            "none": (0, None, 415, got["none"][3]), "a b.pdf": (0, None, 415, "File type mismatch"),
        }


def test_summary_of_the_pass_that_writes(spark, data, tmp_path):
    fixture = spark_fixture(spark, data, "crawl_x").withColumn("decoded_markdown", F.lit("# text").substr(F.lit(1), F.col("page_id") % 6))
    judged = api.outcomes(fixture, cap=3000)
    results, seen = api.page_results(judged), Observation()
    pages.write_results(results, str(tmp_path / "out"), seen=seen)
    key = ["category", "outcome", "http_status"]
    want = api.run_summary(judged, results).filter("outcome = 'ok'").orderBy(*key).collect()
    assert len(want) >= 2
    assert [r.asDict() for r in outcomes.observed_summary(spark, seen).orderBy(*key).collect()] == [r.asDict() for r in want]
    nothing = Observation()
    pages.write_results(results.limit(0), str(tmp_path / "none"), seen=nothing)
    assert outcomes.observed_summary(spark, nothing).count() == 0


def test_pages_delivered_again(spark, tmp_path):
    source, places = str(tmp_path / "in"), {"target": str(tmp_path / "out"), "checkpoint": str(tmp_path / "ck")}

    def deliver(*ids):
        rows = spark.createDataFrame([(i, f"http://h.org/{i}", f"<p>{i}</p>") for i in ids], pages.PAGE_SCHEMA)
        rows.coalesce(1).write.mode("append").parquet(source)

    def written():
        page_stream.stream_pages(
            spark, source, pages.PAGE_SCHEMA, lambda b: b.select("page_id", "url"), **places, max_files=1, once_within="7 days"
        )
        return sorted(r.page_id for r in spark.read.parquet(places["target"]).collect())

    deliver(1, 2, 2)
    deliver(2, 3)
    assert written() == [1, 2, 3]
    # The stream starts again from its checkpoint.
    deliver(3, 1, 4)
    assert written() == [1, 2, 3, 4]


def test_page_stream_equals_batch(spark, data, tmp_path):
    source = str(tmp_path / "in")
    spark.read.parquet(f"{data}/pages.parquet").repartition(3).write.parquet(source)

    def job(batch):
        return to_markdown(batch).select("page_id", "markdown")

    target = page_stream.stream_pages(
        spark, source, pages.PAGE_SCHEMA, job, str(tmp_path / "out"), str(tmp_path / "ck"), max_files=1
    )
    streamed = spark.read.parquet(target)
    batch = job(pages.read_pages(spark, f"{data}/pages.parquet"))
    assert streamed.select("batch").distinct().count() == 3
    assert streamed.drop("batch").exceptAll(batch).count() == 0 and streamed.count() == batch.count()
    # Nothing new: a second run adds nothing.
    page_stream.stream_pages(spark, source, pages.PAGE_SCHEMA, job, str(tmp_path / "out"), str(tmp_path / "ck"), max_files=None)
    assert spark.read.parquet(target).count() == batch.count()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_job_moves_pages_once(spark, data):
    source = pages.read_pages(spark, f"{data}/pages.parquet")
    plan = plan_of(to_markdown(source, carry=("url",)))
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    assert len(re.findall(r"\bExchange\b", plan_of(api.page_links(source)))) <= 1


def test_blocks_move_not_pages(spark, data):
    source = pages.read_pages(spark, f"{data}/pages.parquet")
    made = to_markdown(source, carry=("url",))
    plan = plan_of(made)
    assert len(re.findall(r"\bExchange\b", plan)) == 1
    # The shuffle comes after the cut: below it in the printed tree.
    assert plan.index("Exchange") < plan.index("Generate") and "html" not in plan[plan.index("Exchange"):plan.index("Generate")].split("\n")[0]
    assert made.count() == source.count()
    assert len(re.findall(r"\bExchange\b", plan_of(api.page_links(source)))) == 0
    assert len(re.findall(r"\bExchange\b", plan_of(api.host_link_counts(source)))) == 1
    chosen = source.select("page_id", "html", F.lit("nav a").alias("selector"))
    # A selector's pages are hashed once, and that exchange is read again for the content.
    assert set(payload_moves(api.select_content(chosen))) <= {"Exchange", "ReusedExchange"}


def payload_moves(df):
    """Exchanges that a page's text or body goes through."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            node = node.executedPlan()
        if "Exchange" in node.nodeName():
            names = {node.output().apply(i).name() for i in range(node.output().size())}
            if names & {"html", "body"}:
                found.append(node.nodeName())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_lookups_move_no_pages(spark, data, tmp_path, monkeypatch):
    source = pages.as_crawl(pages.read_pages(spark, f"{data}/pages.parquet"))
    hosts = source.select(url_parts(F.col("url"))["host"].alias("host")).distinct().collect()
    dns = spark.createDataFrame([(h.host, "10.0.0.1" if i % 3 == 0 else "93.184.1.1") for i, h in enumerate(hosts)], "host string, addr string")
    judged = api.outcomes(source, dns=dns)
    assert payload_moves(judged) == [] and payload_moves(guard.guard(source, dns=dns)) == []
    # Only the blocks' text is shuffled for the results.
    assert payload_moves(api.page_results(judged)) == []
    few = {(r.page_id, r.outcome) for r in judged.select("page_id", "outcome").collect()}
    assert {o for _, o in few} == {"ok", "blocked"}
    # Many hits: a bucketed crawl stays where it is, the hits come to it.
    monkeypatch.setattr(guard, "MOST_BROADCAST", 0)
    saved = pages.save_crawl(source, "crawl_by_page", str(tmp_path / "crawl"), 3)
    judged = api.outcomes(saved, dns=dns)
    plan = plan_of(judged)
    assert payload_moves(judged) == [] and "ShuffledHashJoin" in plan and "Bucketed: true" in plan
    assert {(r.page_id, r.outcome) for r in judged.select("page_id", "outcome").collect()} == few
    assert payload_moves(api.outcomes(source, dns=dns)) != []  # what the test would see otherwise
    spark.sql("DROP TABLE crawl_by_page")


def test_no_python_in_any_plan(spark, data):
    for name in ("page_results", "page_outcomes", "crawl_frontier", "over_limit_requests", "select_content"):
        plan = plan_of(QUERIES[name](spark, data))
        assert "PythonUDF" not in plan and "ArrowEval" not in plan and "BatchEvalPython" not in plan, name
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_error_rows_need_no_html(spark, data):
    source = pages.as_crawl(pages.read_pages(spark, f"{data}/pages.parquet"))
    plan = plan_of(api.page_errors(api.outcomes(source)))
    schema = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert schema and all("html" not in s for s in schema)


def test_frontier(spark):
    rows = spark.createDataFrame(
        [
            (1, "http://h.org/a", "<a href=/b>b</a><a href=/b#x>b</a><a href=/a>a</a><a href=http://o.org/>o</a>"),
            (2, "http://h.org/c", "<a href=b>b</a>"),
        ],
        "page_id long, url string, html string",
    )
    assert [tuple(r) for r in api.crawl_frontier(rows, rows).collect()] == [("http://h.org/b", 2)]
    top = api.top_targets(rows, 1).collect()
    assert [(r.host, r.target, r.n_links, r.n_pages) for r in top] == [("h.org", "/b", 3, 2)]
    counts = api.host_link_counts(rows).agg(F.sum("n_links")).first()[0]
    assert counts == 4
