"""Document files with name, size and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.content import (
    MAX_BYTES,
    file_extension,
    file_name,
    first_bytes,
    intake_error,
    intake_status,
    resolve_kind,
)
from pagemill.sources.listing import FileListing


def heads(files: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """`files(path, length, content)` with `head`, the first bytes, in place of the content.

    Only PDF names within the cap have their content read: the tests on length
    and path come first, and Spark's file source reads no file whose content is
    not asked for.
    """
    wanted = (F.col("length") <= cap) & (file_extension(F.col("path")) == "pdf")
    opened = files.filter(wanted).select("path", "length", first_bytes(F.col("content")).alias("head"))
    others = files.filter(~wanted).select("path", "length", F.lit(None).cast("binary").alias("head"))
    return opened.unionByName(others)


def read_files(spark: SparkSession, path: str, cap: int = MAX_BYTES) -> DataFrame:
    """(path, length, head) of every file under `path`.

    Spark's file sources pass over files of zero bytes; those come from the listing.
    """
    files = heads(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), cap)
    spark.dataSource.register(FileListing)
    listed = spark.read.format(FileListing.name()).load(path)
    empty = listed.filter("length = 0").select("path", "length", F.lit(None).cast("binary").alias("head"))
    return files.unionByName(empty)


def doc_intake(files: DataFrame, cap: int = MAX_BYTES) -> DataFrame:
    """(url, length, kind, error, status) for `files(path, length, head)`.

    Size is reported before extension; a PDF name needs PDF bytes.
    """
    kind = resolve_kind(F.col("path"), F.col("head"))
    rows = files.select(
        file_name(F.col("path")).alias("url"),
        "length",
        kind.alias("kind"),
        intake_error(F.col("path"), F.col("length"), cap).alias("_error"),
        intake_status(F.col("path"), F.col("length"), cap).alias("_status"),
    )
    mismatch = F.col("_status").isNull() & F.col("kind").isNull()
    return rows.select(
        "url",
        "length",
        F.when(F.col("_status").isNull(), F.col("kind")).alias("kind"),
        F.when(mismatch, F.lit("File type mismatch")).otherwise(F.col("_error")).alias("error"),
        F.when(mismatch, F.lit(415)).otherwise(F.col("_status")).alias("status"),
    )
