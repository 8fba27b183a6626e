"""The calls a user makes, each `DataFrame -> DataFrame`."""

from __future__ import annotations

from pagemill.operators.guard import guard
from pagemill.operators.limits import (
    block_intervals,
    blocked_requests,
    over_limit_requests,
    request_counts,
)
from pagemill.operators.links import crawl_frontier, host_link_counts, page_links, top_targets
from pagemill.operators.markdown import to_markdown
from pagemill.operators.outcomes import outcomes, page_errors, page_metrics, page_results, run_summary
from pagemill.operators.select import select_content


def extract(crawl, **options):
    """Results of a crawl table in one call: outcomes, then the `ok` rows."""
    return page_results(outcomes(crawl, **options))


__all__ = [
    "block_intervals",
    "blocked_requests",
    "crawl_frontier",
    "extract",
    "guard",
    "host_link_counts",
    "outcomes",
    "over_limit_requests",
    "page_errors",
    "page_links",
    "page_metrics",
    "page_results",
    "request_counts",
    "run_summary",
    "select_content",
    "to_markdown",
    "top_targets",
]
