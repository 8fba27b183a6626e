"""Line dedup: lines that many documents share lose all their places but one.

Normalised lines are exploded as 128-bit hashes, never as text. Distinct documents
per hash are counted in two steps, (hash, document) and then hash, so that a line in
every document is spread over all tasks and combined before it is shuffled. The lines
over the threshold come back to their documents as a list of hashes, those of hot lines
over all tasks, and each text is put together again from its other lines, in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import chunks, narrow, row_schema, stored
from pagemill.operators.layout import salt_count

WHITE = " \t\n\x0b\x0c\r"
#: A key with over a HOT-th of all pairs is hot.
HOT = 1000


def line_key(line: str, shortest: int) -> bytes | None:
    """Hash of a line without white space at its ends and with A-Z in lower case; None if it is short."""
    bare = line.strip(WHITE)
    if len(bare) < shortest:
        return None
    return xxhash.xxh3_128_digest(bare.encode("utf-8", "surrogatepass").lower())


def line_keys(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, keys array<binary>): the distinct keys of every text's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                found = [
                    [k for k in {line_key(x, shortest) for x in (t or "").split("\n")} if k]
                    for t in batch.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(found, pa.list_(pa.binary()))], names=["doc_id", "keys"]
                )

    return docs.mapInArrow(run, "doc_id long, keys array<binary>")


def without_lines(docs: DataFrame, shortest: int) -> DataFrame:
    """docs(doc_id, text, drop) as (doc_id, n_lines, n_dropped, text) without the lines whose keys are in drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                n_lines, n_dropped, texts = [], [], []
                for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    gone = set(drop or ())
                    kept = [x for x in lines if line_key(x, shortest) not in gone] if gone else lines
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                found = (pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *found, *map(batch.column, rest)],
                    names=["doc_id", "n_lines", "n_dropped", "text", *rest],
                )

    rest = [c for c in docs.columns if c == "row"]
    rows = docs.select("doc_id", "text", "drop", *rest)
    return rows.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string" + row_schema(rows))


def holders(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """pairs(doc_id, key) whose key is in common(key, keeper, n), as (doc_id, key, keeper).

    A key that holds over a HOT-th of all these pairs is dealt over as many places as a
    shuffle has partitions. There are less than HOT such keys, so they are broadcast.
    """
    total, salts = common.agg(F.sum("n")).first()[0] or 0, salt_count()
    hot = F.col("n") * HOT > total
    spread = pairs.join(F.broadcast(common.where(hot).select("key", F.lit(salts).alias("places"))), "key", "left")
    # Any place finds the key, so a row that draws another one in a second run loses nothing.
    drawn = F.pmod(F.monotonically_increasing_id(), F.col("places")).cast("int")
    spread = spread.select("doc_id", "key", F.coalesce(drawn, F.lit(0)).alias("place"))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(common.select("key", "keeper", F.explode(every).alias("place")), ["key", "place"]).drop("place")


def dedup_lines(docs: DataFrame, shortest: int = 40, documents: int = 5, carry: bool = False) -> DataFrame:
    """docs(doc_id, text) without its repeated lines: doc_id, n_lines, n_dropped, text.

    Lines are cut at line feeds; a null or empty text is one empty line and becomes
    the empty text. A line's key has its ASCII white space stripped and A-Z lower-cased.
    Keys of at least shortest code points in at least that many different documents
    lose all their lines but those of the largest doc_id that holds them. Rows that
    share a doc_id count as one document and are treated alike, so the survivor keeps
    its lines in each of them. Rows with a null doc_id are not counted and lose
    nothing. n_lines counts before dropping. Other columns are left
    out; with carry they come along as row.
    """
    texts = narrow(docs, carry)
    keyed = line_keys(texts.where("doc_id IS NOT NULL").select("doc_id", "text"), shortest)
    pairs = keyed.select("doc_id", F.explode("keys").alias("key"))
    counts = pairs.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
    common = stored(counts.where(F.col("n") >= documents), "common-lines")
    lost = holders(pairs, common).where("doc_id <> keeper")
    drops = lost.groupBy("doc_id").agg(F.collect_set("key").alias("drop"))
    return without_lines(texts.join(drops, "doc_id", "left"), shortest)
