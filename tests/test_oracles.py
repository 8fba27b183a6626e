"""Every query against its SQL in another engine.

A cross-section by default; all of them with PAGEMILL_ALL=1.
"""

import os

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries
from pagemill.plans.oracles import ORACLES
from pagemill.plans.queries import QUERIES

SOME = (
    "validate_url", "ip_canonical", "url_parts", "normalize_url", "resolve_href", "same_host_links", "refine_by_extension",
    "intake_limits", "host_allow_join", "cidr_allow_join", "page_outcomes", "anchor_fields", "decode_entities", "page_links",
    "main_content_blocks", "page_markdown", "md_paragraphs", "md_tables", "list_items", "select_content", "run_summary",
    "over_limit_requests", "blocked_requests", "stream_request_counts",
)
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    rows = []
    for row in df.astype(object).where(df.notna(), None).values.tolist():
        rows.append(tuple(int(x) if isinstance(x, float) and x == int(x) else x for x in row))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", list(ORACLES) if os.environ.get("PAGEMILL_ALL") else SOME)
def test_query_matches(spark, duck, data, name):
    mine = queries()[name](spark, data).toPandas()
    theirs = duck.execute(oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows_of(mine) == rows_of(theirs)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())
