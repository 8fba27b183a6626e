"""Choices about where rows live."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Rows of one key that a join leaves to one task.
HOT = 50_000
# Tasks per shuffle partition for pages that are cut into tags.
PAGE_TASKS = 4
# Places for rows that meet nothing.
ANYWHERE = 1 << 20


def salt_count() -> int:
    """Tasks that may share one hot key: as many as a shuffle has partitions."""
    return max(1, int(SparkSession.active().conf.get("spark.sql.shuffle.partitions")))


def deal_pages(pages: DataFrame) -> DataFrame:
    """`pages` hashed by `page_id`, to be cut into tags and sorted many times where they lie.

    Some twenty sorts of its tags make a page a few hundred times as large as it is
    in a shuffle, so Spark's merging of small partitions, which a number of them
    turns off, would leave too much to one task.
    """
    return pages.repartition(PAGE_TASKS * salt_count(), "page_id")


def hot_keys(rows: DataFrame, on: list[str], most: int | None = None) -> DataFrame:
    """The keys of more than `most` (HOT) rows, with `_shares`, the tasks to share
    them: one per `most` rows. There are fewer of them, and of their shares beyond
    the first, than `rows` divided by `most`, so they may go to every task."""
    most = most or HOT
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_shares")).filter(F.col("_shares") > most)
    return counted.withColumn("_shares", F.ceil(F.col("_shares") / most).cast("int"))


def shared_keys(rows: DataFrame, known: DataFrame, hot: DataFrame, on: list[str], place: Column) -> tuple[DataFrame, DataFrame]:
    """Both with `_salt`, to be joined on `on` and `_salt`.

    Rows of a hot key draw one of its shares by `place`, and `known` is written once
    per share; other keys are as they are. Spark does not count what an explode
    adds when it decides on a broadcast; here that is less than a row per HOT rows.
    Rows with a null among `on` meet nothing and go anywhere.
    """
    shares = F.coalesce("_shares", F.lit(1))
    unmet = reduce(or_, [F.col(c).isNull() for c in on])
    drawn = F.pmod(place, F.when(unmet, ANYWHERE).otherwise(shares))
    rows = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", drawn.cast("int"))
    known = known.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), shares - 1)))
    return rows.drop("_shares"), known.drop("_shares")


def mark_known(rows: DataFrame, known: DataFrame, on: str, flag: str) -> DataFrame:
    """Add boolean `flag`: is `on` among the keys of `known`?

    One key may hold a large part of `rows`, so a hot one is shared by tasks: its
    rows draw a share by their place, whatever they hold, and even where they are
    equal. Any share finds its key, so a row that draws another one when its task
    runs again gets the same flag. Where Spark's own size check finds `known`
    small it broadcasts it and `rows` do not move.
    """
    keys = known.select(on).distinct().withColumn(flag, F.lit(True))
    rows, keys = shared_keys(rows, keys, hot_keys(rows, [on]), [on], F.monotonically_increasing_id())
    return rows.join(keys, [on, "_salt"], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_salt")


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder name in the storage that the cluster names in spark.checkpoint.dir."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("name a target and a checkpoint, or set spark.checkpoint.dir to shared storage")
    return f"{root.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"


def working_folder(spark: SparkSession, prefix: str) -> str:
    """A new shared folder; in a session of one machine that names none, a temporary one."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.startswith("local["):
        return f"{tempfile.mkdtemp(prefix='pagemill-')}/{prefix}"
    return shared_folder(spark, prefix)


def stored(rows: DataFrame, prefix: str) -> DataFrame:
    """rows written to a working folder and read back."""
    path = working_folder(rows.sparkSession, prefix)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
