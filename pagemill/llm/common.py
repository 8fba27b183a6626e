"""Helpers of the training-data operators: shared storage and Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the storage that the cluster names in spark.checkpoint.dir.

    Only a local session (one machine) may leave that unset; it then gets a
    temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to storage that all executors share")
        base = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/pagemill-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: a cut lineage that outlives executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of shared_folder that is no longer read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def narrow(docs: DataFrame, carry: bool) -> DataFrame:
    """doc_id and text of docs; with carry also row, a struct of all its columns but text.

    An operator takes row through its pass over the texts, so that a stage gets its
    table back without joining it again, whatever the columns are called.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if carry else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *rest)


def row_schema(rows: DataFrame) -> str:
    """Schema text of the carried row, with a leading comma; empty without one."""
    return f", row {rows.schema['row'].dataType.simpleString()}" if "row" in rows.columns else ""


def unpacked(found: DataFrame, columns: list[str], text: str) -> DataFrame:
    """A table with the given columns again, from a carried row and a text; n_chars follows the text."""
    made = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*((made[c] if c in made else F.col(f"row.`{c}`")).alias(c) for c in columns))


def sampled_ids(rows: DataFrame, column: str, n: int) -> list[int]:
    """n ids of a column, those with the least hashes; nulls are passed over.

    A first cut by hash leaves about 2 n of them, so that no task sends more than its share.
    """
    ids = rows.select(F.col(column).cast("long").alias("id")).where("id IS NOT NULL")
    key, total = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), ids.count()
    if total > 4 * n:
        ids = ids.where(key < (1 << 40) * 2 * n // total)
    return [r["id"] for r in ids.orderBy(key, "id").limit(n).collect()]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of batch with about limit bytes of column each; a longer row stands alone."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)
