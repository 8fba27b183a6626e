"""Centroid clustering with ns-bounds over whole numbers.

The vectors are stored once in chunk rows, bucketed by chunk; each round stores the
chunks' state (a vector's centroid, the round it was last measured in, and its
distances to that centroid and to the next one then) bucketed alike, so that a round is a
join without a shuffle. The driver keeps every round's centroids. A stored distance is
loosened by how far a centroid lies from where it was when the distance was measured:
the norm of its total displacement, not the sum of its drifts. Where these bounds do
not prove that a vector stays, all its distances are measured again, exactly. Rounds
send back what moved between clusters, as whole sums.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import discard, shared_folder, stored

CHUNK_ROWS, BUCKET_BYTES = 1024, 64 << 20
FAR = (1 << 63) - 1
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def largest(dim: int) -> int:
    """Bound of the components: a squared distance between vectors below it fits a long."""
    return min(math.isqrt((1 << 60) // dim), 1 << 30)


def usable(vector: Column, dim: int, scale: int) -> Column:
    """Whether a vector takes part: dim components, none null or non-finite, none beyond largest when scaled."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(largest(dim) / scale)))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, vector array<int>) of vectors(vec_id, embedding): floor(scale * x) of those that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x"), dim, scale))
    return rows.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("vector"))


def in_chunks(rows: DataFrame, dim: int) -> DataFrame:
    """rows(vec_id, vector) as (chunk, ids, vectors): arrays of at most CHUNK_ROWS vectors, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, CHUNK_ROWS):
                part = whole.slice(start, CHUNK_ROWS)
                ids = part.column("vec_id").to_numpy(zero_copy_only=False).astype("<i8")
                vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield pa.RecordBatch.from_pydict({"chunk": [chunk], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})
                chunk += 1

    return rows.mapInArrow(run, "chunk long, ids binary, vectors binary")


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors x centroids."""
    largest = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * vectors.shape[1] * largest**2 < 1 << 53:  # whole numbers that doubles hold
        v, c = vectors.astype(float), centroids.astype(float)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    v = vectors.astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def displacements(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own, others), rounds x centroids: how far a centroid is now from where it was, and the most any other one is."""
    apart = (history[-1] - history).astype(float)
    own = np.sqrt((apart * apart).sum(2)) * (1 + 1e-9)
    order = np.sort(own, axis=1)
    if own.shape[1] == 1:
        return own, np.zeros_like(own)
    most, second = order[:, -1:], order[:, -2:-1]
    only = np.arange(own.shape[1]) == own.argmax(1)[:, None]
    return own, np.where(only, second, most)


def assign(vectors: np.ndarray, state: tuple[np.ndarray, ...] | None, history: np.ndarray, moved: tuple | None = None) -> tuple[tuple, int]:
    """State of the vectors under the last centroids of history, and how many were measured again.

    state is (own, at, near, next): the centroid, the round of the last measurement, and the
    squared distances to that centroid and the nearest other one in that round.
    """
    now, n = len(history) - 1, len(vectors)
    if state is None:
        own, at = np.zeros(n, np.int32), np.zeros(n, np.int32)
        near, next_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
        todo = np.arange(n)
    else:
        own, at, near, next_ = (x.copy() for x in state)
        mine, others = moved or displacements(history)
        reach = np.sqrt(near.astype(float)) * (1 + 1e-9) + mine[at, own]
        room = np.sqrt(next_.astype(float)) * (1 - 1e-9) - others[at, own]
        todo = np.flatnonzero(~(reach < room))
    if len(todo):
        far = squared_distances(vectors[todo], history[-1])
        rows, best = np.arange(len(todo)), far.argmin(1)
        own[todo], at[todo], near[todo] = best, now, far[rows, best]
        far[rows, best] = FAR
        next_[todo] = far.min(1)
    return (own, at, near, next_), len(todo)


def transfers(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """k x (dim + 1): sums of the components and numbers of the vectors that came to each centroid less those that left."""
    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    gone = np.arange(len(new)) if old is None else np.flatnonzero(old != new)
    rows = np.concatenate((vectors[gone].astype(np.int64), np.ones((len(gone), 1), np.int64)), 1)
    for sign, where in ((1, new[gone]), (-1, None if old is None else old[gone])):
        if where is not None:
            for j in np.unique(where):
                out[j] += sign * rows[where == j].sum(0)
    return out


class Bucketed:
    """A table in shared storage, bucketed by chunk: Spark joins two with as many buckets where they lie."""

    def __init__(self, rows: DataFrame, buckets: int) -> None:
        self.spark, self.name, self.folder = rows.sparkSession, f"chunks_{uuid.uuid4().hex}", shared_folder(rows.sparkSession)
        rows.write.bucketBy(buckets, "chunk").option("path", self.folder).saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.folder)


def states(chunks: DataFrame, dim: int, history: np.ndarray) -> DataFrame:
    """chunks(chunk, vectors [, own, at, near, next]) as their state under the last centroids of history.

    chunk, own, at, near, next, measured (vectors measured again) and moves: what transfers
    gives, row after row, or null where nothing moved.
    """
    kinds = {"own": "<i4", "at": "<i4", "near": "<i8", "next": "<i8"}
    going_on = "own" in chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = displacements(history)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dim)
                old = tuple(np.frombuffer(row[n], t) for n, t in kinds.items()) if going_on else None
                new, measured = assign(vectors, old, history, moved)
                moves = transfers(vectors, old[0] if old else None, new[0], history.shape[1])
                out = {"chunk": [row["chunk"]]} | {n: [x.astype(t).tobytes()] for (n, t), x in zip(kinds.items(), new, strict=True)}
                out |= {"measured": [measured], "moves": pa.array([moves.ravel() if moves.any() else None], pa.list_(pa.int64()))}
                yield pa.RecordBatch.from_pydict(out)

    kept = ["chunk", "vectors", *(kinds if going_on else ())]
    schema = "chunk long, own binary, at binary, near binary, next binary, measured long, moves array<long>"
    return chunks.select(*kept).mapInArrow(run, schema)


def joined(chunks: DataFrame, state: DataFrame | None) -> DataFrame:
    """Chunk rows with their state; both are bucketed alike, and the small side is hashed, so nothing moves or is sorted."""
    return chunks if state is None else chunks.join(state.drop("measured", "moves").hint("shuffle_hash"), "chunk")


def settled(chunks: DataFrame, dim: int, history: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) under the last centroids of history, for chunks with state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = displacements(history)
        for batch in batches:
            for row in batch.to_pylist():
                vectors = np.frombuffer(row["vectors"], "<i4").reshape(-1, dim)
                old = (np.frombuffer(row["own"], "<i4"), np.frombuffer(row["at"], "<i4"))
                old += (np.frombuffer(row["near"], "<i8"), np.frombuffer(row["next"], "<i8"))
                own = assign(vectors, old, history, moved)[0][0]
                apart = vectors.astype(np.int64) - history[-1][own]
                ids = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(own, pa.int32()), pa.array((apart * apart).sum(1), pa.int64())],
                    names=["vec_id", "cluster", "distance"],
                )

    columns = ["ids", "vectors", "own", "at", "near", "next"]
    return chunks.select(*columns).mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, dim: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vectors(vec_id, embedding) in k clusters: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components become floor(scale * x). Centroids 0, 1, ... start as the k vectors with the
    smallest SHA-256 of seed:vec_id, ties to the smaller vector; with fewer vectors there
    are fewer centroids. Each round gives every vector to the nearest centroid (squared
    Euclidean distance, ties to the smaller number) and moves every centroid that has
    vectors to the floor of their mean; then all are assigned once more. Everything is
    whole numbers, so the result depends on no order. Rounds that would change nothing
    are left out. distance is squared; inertia sums distances over the cluster and over all
    (no more than a long holds); the digest is that of the centroid's components joined by commas.

    Rows without vec_id, null vectors, other lengths, null or non-finite components, and
    components for which squared distances would not fit a long (2^27 scaled, for 64) take no
    part. Repeated rows are rows of their own. Other columns are left out. An empty
    table gives an empty one. Of the vectors the driver gets k, and k * (dim + 1) sums a round;
    tasks get rounds * k * dim numbers.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, dim, scale)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = [r["vector"] for r in rows.select("vector", key.alias("key")).orderBy("key", "vector").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array(first, np.int64)
    k, history = len(centroids), [centroids]
    n = vectors.count()
    buckets = max(-(-4 * n * dim // BUCKET_BYTES), min(spark.sparkContext.defaultParallelism, -(-n // CHUNK_ROWS)))
    whole = Bucketed(in_chunks(rows, dim).repartition(buckets, "chunk"), buckets)
    state: Bucketed | None = None
    total = [0] * (k * (dim + 1))
    try:
        for _ in range(rounds):
            before, now = state, states(joined(whole.rows, state and state.rows), dim, np.stack(history))
            state = Bucketed(now, buckets)
            if before:
                before.drop()
            moves = state.rows.select(F.posexplode("moves").alias("i", "n")).groupBy("i")
            for r in moves.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
                total[r["i"]] += int(r["n"])
            sums = np.array(total, object).reshape(k, dim + 1)
            centroids = np.array([s[:dim] // s[dim] if s[dim] else c for s, c in zip(sums, history[-1], strict=True)], np.int64)
            if (centroids == history[-1]).all():
                break
            history.append(centroids)
        done = joined(whole.rows, state and state.rows)
        if state is None:
            state = Bucketed(states(whole.rows, dim, np.stack(history)), buckets)
            done = joined(whole.rows, state.rows)
        found = stored(settled(done, dim, np.stack(history)), "clusters")
    finally:
        whole.drop()
        if state:
            state.drop()
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    inertia = {r["cluster"]: int(r["n"]) for r in sums}
    every = F.lit(min(sum(inertia.values()), FAR))
    own = F.array(*(F.lit(min(inertia.get(j, 0), FAR)).cast("long") for j in range(k)))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    return found.select(
        "vec_id", "cluster", "distance",
        F.get(own, F.col("cluster")).alias("cluster_inertia"),
        every.cast("long").alias("inertia"),
        F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"),
    )
