"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query writes all its rows to the noop sink. The first run of a query is
left out; the figure is the median of three more, building the plan included.
`plan` has the seconds of that median run until the physical plan stood.

The page jobs cut pages where they are read, so a crawl should have files enough for
all cores. The given tables are one file each; before the clock starts, each is dealt
into a file per core in a temporary folder of this machine.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans.queries import QUERIES  # noqa: E402

HEADLINE = (
    "page_links",
    "page_markdown",
    "page_outcomes",
    "page_results",
    "host_link_counts",
    "crawl_frontier",
    "cidr_allow_join",
    "request_counts",
    "over_limit_requests",
    "blocked_requests",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE

    tables = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(folder)):
        source = spark.read.parquet(f"{folder}/{name}")
        source.repartition(int(cpus)).write.parquet(f"{tables}/{name}")

    def once(name: str) -> tuple[float, float]:
        begin = time.perf_counter()
        made = QUERIES[name](spark, tables)
        made._jdf.queryExecution().executedPlan()
        planned = time.perf_counter() - begin
        made.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begin, planned

    times, plans = {}, {}
    for name in wanted:
        once(name)
        took, planned = sorted(once(name) for _ in range(RUNS))[RUNS // 2]
        times[name], plans[name] = round(took, 3), round(planned, 3)
    n_pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    print(
        json.dumps(
            {
                "metric": "total of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "plan": plans,
                "pages": n_pages,
                "pages_per_sec": {
                    q: round(n_pages / times[q], 1)
                    for q in ("page_links", "page_markdown", "page_outcomes", "page_results")
                    if q in times
                },
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
