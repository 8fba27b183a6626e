"""What one task sorts of the blocks of pages."""

import re

from pyspark.sql import functions as F

from pagemill.operators.blocks import page_blocks, with_structure
from pagemill.operators.select import select_content


def test_blocks_are_dealt_out_after_pages_are_cut(spark):
    """Pages that a grouping hashed by their key may become a hundred times their size."""
    made = spark.range(50).groupBy((F.col("id") % 10).alias("page_id")).agg(
        F.concat(F.lit("<ol start=4>"), F.array_join(F.collect_list(F.format_string("<li>x%d<ul><li>y</ul>", "id")), ""), F.lit("</ol>")).alias("html")
    )
    rows = with_structure(page_blocks(made))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange") < plan.index("Generate")
    assert len(re.findall(r"^[^\w\n]*Sort ", plan, re.M)) == 3
    got = rows.filter("leads_item AND list_depth = 1 AND page_id = 3").orderBy("block_id").select("number", "text").collect()
    assert [r.number for r in got] == [4, 5, 6, 7, 8] and all(r.text.startswith("x") for r in got)
    assert rows.filter("leads_item AND list_depth = 2").agg(F.count("*"), F.count("number")).first()[:] == (50, 0)


def test_pages_to_select_from_keep_their_tasks(spark):
    """Their partitions are not merged, however small the pages are before they are cut."""
    pages = spark.range(40).selectExpr("id AS page_id", "'<p>a</p><p>b' AS html", "'p + p' AS selector")
    found = select_content(pages)
    plan = found._jdf.queryExecution().executedPlan().toString()
    moves = re.findall(r"Exchange hashpartitioning\(page_id#\d+L, (\d+)\), (\w+)", plan)
    assert moves and set(moves) == {(str(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), "REPARTITION_BY_NUM")}
    assert found.select("content").distinct().collect() == [("b",)]
