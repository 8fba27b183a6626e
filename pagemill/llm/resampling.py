"""Importance resampling towards a target: hashed word runs, gains per bucket, Gumbel top-k.

A batch's texts are joined with separator sentinels; one regex pass finds all words,
a binary search in the documents' offsets tells whose they are, and runs of words
that cross into another document are masked before they are counted. One pass sums
the buckets of all documents and of the target, a second one adds up the gains per
document. The draw is one range shuffle of narrow rows; ranks follow from the place
in a partition and the sizes of the partitions before it.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import chunks, stored

# Bytes of a word: what is no ASCII sign and no capital, in UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
BUCKETS, WORDS_AT_ONCE = 10000, 1 << 18


def features(texts: pa.Array, longest: int, at_once: int = WORDS_AT_ONCE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, documents, hashes) of all runs of n = 1 to longest words within one text, some at a time.

    documents holds the places of the texts that the runs lie in, hashes their CRC-32.
    At most at_once words are held, with the longest - 1 before them.
    """
    whole = b"\0".join(pc.fill_null(texts.cast(pa.binary()), b"").to_pylist()).lower()
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    found = WORD.finditer(whole)
    words: list[bytes] = []
    owners = np.zeros(0, np.int64)
    while block := list(itertools.islice(found, at_once)):
        before = min(len(words), longest - 1)
        places = np.fromiter((m.start() for m in block), np.int64, len(block))
        owners = np.concatenate((owners[len(owners) - before :], np.searchsorted(starts, places, "right") - 1))
        words = words[len(words) - before :] + [m[0] for m in block]
        for n in range(1, longest + 1):
            first = max(before - n + 1, 0)  # runs that end before the block are counted already
            ends = owners[first + n - 1 :]
            inside = owners[first : first + len(ends)] == ends
            runs = words[first:] if n == 1 else map(b" ".join, zip(*(words[first + i :] for i in range(n)), strict=False))
            hashes = np.fromiter(map(crc32, runs), np.int64, len(ends))
            yield n, ends[inside], hashes[inside]


def bucket_counts(rows: DataFrame, longest: int, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of rows(text) fall into each bucket; the driver gets a number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in chunks(batch, "text"):
                for _, _, hashes in features(part.column("text"), longest):
                    total += np.bincount(hashes % buckets, minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["bucket", "n"])

    counted = rows.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share of the target over its share of the source, one added to every bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of docs(doc_id, text); the gains travel with the tasks, a long per bucket."""
    buckets, added = len(gains), gains.astype(float)

    def noise(doc_id: int | None) -> int | None:
        if doc_id is None:
            return None
        h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                size = part.num_rows
                n_words, n_features, weight = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size)
                for n, owners, hashes in features(part.column("text"), longest):
                    own = np.bincount(owners, minlength=size)
                    n_words += own * (n == 1)
                    n_features += own
                    # Sums of whole numbers far below 2^53: exact in doubles.
                    weight += np.bincount(owners, added[hashes % buckets], minlength=size)
                whole = weight.astype(np.int64)
                luck = [noise(i) for i in part.column("doc_id").to_pylist()]
                score = [None if x is None else int(w) + x for w, x in zip(whole, luck, strict=True)]
                found = [pa.array(x, pa.int64()) for x in (n_words, n_features, whole, score)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *found], names=["doc_id", "n_words", "n_features", "weight", "score"]
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, percent: int = 10, shortest: int = 20, seed: int = 2024
) -> DataFrame:
    """docs(doc_id, text) weighed by their likeness to target(text): doc_id, n_features, weight, score, rank.

    Features are the runs of 1 to longest words of a text, A-Z lower-cased, repeats
    counted; a bucket is the CRC-32 of the run, its words joined by one space, modulo
    buckets. weight is the sum of the gains of a text's features, score is weight and a
    Gumbel draw from the hash of seed and doc_id. Of the documents with at least
    shortest words, floor(percent / 100) have the ranks 1, 2, 3...: the highest scores,
    ties to the smaller doc_id; the rest have rank null. Null and empty texts have no
    features and weight 0. Rows with a null doc_id count for the gains, but have no
    score and are not drawn. Repeated rows are rows of their own; of equal ones it does
    not matter which has the better rank. Other columns are left out. Empty tables give
    empty ones; an empty target is one with no word.
    """
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weighed = stored(weigh(docs, gains, longest, seed), "weighed")
    takes_part = (F.col("n_words") >= shortest) & F.col("score").isNotNull()
    # Equal rows may go to any partition, so that no id and no score is one task's.
    order = [F.desc("eligible"), F.desc("score"), F.asc("doc_id"), F.asc("salt")]
    dealt = weighed.withColumns({"eligible": takes_part, "salt": F.rand(seed)}).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(dealt.withColumn("place", F.monotonically_increasing_id()).drop("salt"), "placed")
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("eligible").alias("eligible")).collect()
    drawn, before, bases = percent * sum(r["eligible"] for r in sizes) // 100, 0, []
    for r in sorted(sizes, key=lambda r: r["part"]):
        bases.append((r["part"], before))
        before += r["n"]
    firsts = docs.sparkSession.createDataFrame(bases, "part long, base long")  # a row per partition
    ranked = placed.withColumn("part", part).join(firsts, "part").withColumn("rank", F.col("base") + within + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
