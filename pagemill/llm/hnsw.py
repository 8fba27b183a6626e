"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Equal vectors are one node that keeps the smallest of their ids. Nodes are hashed to
shards of bounded size; a task builds the graph of a shard and stores it as flat
neighbour arrays. Queries travel in blocks to every shard, search its graph, and send
back their nearest with exact scores; the merge keeps the best of all shards.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

LINKS, EF_BUILD, EF_SEARCH = 12, 64, 96
SHARD_ROWS, QUERY_BLOCK = 4096, 128


@dataclass
class Graph:
    """Flat arrays: links[level] is nodes x slots, -1 where a slot is free."""

    links: list[np.ndarray]
    entry: int

    def search(self, unit: np.ndarray, query: np.ndarray, ef: int) -> list[tuple[float, int]]:
        """About ef nearest nodes (similarity, node), nearest first."""
        if not len(unit):
            return []
        near = [(float(unit[self.entry] @ query), self.entry)]
        for level in range(len(self.links) - 1, 0, -1):
            near = layer(unit, self.links[level], query, near, 1)
        return layer(unit, self.links[0], query, near, ef)


def layer(unit: np.ndarray, links: np.ndarray, query: np.ndarray, entries: list, ef: int) -> list[tuple[float, int]]:
    """Best-first search of one level with a beam of ef."""
    seen = np.zeros(len(unit), bool)
    seen[[n for _, n in entries]] = True
    best = list(entries)
    heapq.heapify(best)
    todo = [(-s, n) for s, n in entries]
    heapq.heapify(todo)
    while todo:
        s, node = heapq.heappop(todo)
        if len(best) >= ef and -s < best[0][0]:
            break
        around = links[node]
        around = around[around >= 0]
        around = around[~seen[around]]
        if not len(around):
            continue
        seen[around] = True
        for near, n in zip((unit[around] @ query).tolist(), around.tolist(), strict=True):
            if len(best) < ef:
                heapq.heappush(best, (near, n))
            elif near > best[0][0]:
                heapq.heapreplace(best, (near, n))
            else:
                continue
            heapq.heappush(todo, (-near, n))
    return sorted(best, key=lambda x: (-x[0], x[1]))


def choose(unit: np.ndarray, near: list[tuple[float, int]], limit: int) -> list[int]:
    """Of nodes sorted by nearness, up to limit that are nearer to the centre than to those chosen before."""
    nodes = np.array([n for _, n in near])
    among = unit[nodes] @ unit[nodes].T
    closest = np.full(len(nodes), -np.inf, among.dtype)
    taken, passed = [], []
    for i, (s, n) in enumerate(near):
        if len(taken) == limit:
            break
        if s >= closest[i]:
            taken.append(n)
            np.maximum(closest, among[i], out=closest)
        else:
            passed.append(n)
    return [*taken, *passed[: limit - len(taken)]]


def build(unit: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """Graph over unit vectors, inserted in the order given; the same input gives the same graph."""
    n = len(unit)
    draws = np.random.default_rng(n).random(n)
    height = np.minimum((-np.log(1 - draws) / math.log(links)).astype(int), 6)
    levels = [np.full((n, 2 * links if level == 0 else links), -1, np.int32) for level in range(int(height.max(initial=0)) + 1)]
    if not n:
        return Graph(levels, 0)
    entry, top = 0, int(height[0])
    for node in range(1, n):
        query, own = unit[node], int(height[node])
        near = [(float(unit[entry] @ query), entry)]
        for level in range(top, own, -1):
            near = layer(unit, levels[level], query, near, 1)
        for level in range(min(top, own), -1, -1):
            near = layer(unit, levels[level], query, near, ef)
            table, slots = levels[level], levels[level].shape[1]
            chosen = choose(unit, near, links)
            table[node, : len(chosen)] = chosen
            for other in chosen:
                row = table[other]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = node
                    continue
                around = np.append(row, node)
                order = sorted(zip((unit[around] @ unit[other]).tolist(), around.tolist(), strict=True), key=lambda x: (-x[0], x[1]))
                kept = choose(unit, order, slots)
                row[:] = -1
                row[: len(kept)] = kept
        if own > top:
            entry, top = node, own
    return Graph(levels, entry)


def normalised(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision, safe for very large and very small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))).astype(np.float32)


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; equal vectors get equal values."""
    return (vectors * query).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((query * query).sum()))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: no null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def index(vectors: DataFrame, keep: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs of vectors(vec_id, vector array<double>), one row per shard, stored.

    keep: ids that a node holds at most, the smallest ones; a search for k others needs k + 1.
    """
    hashes = [F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")]
    by_vector = Window.partitionBy("h", "g").orderBy("vec_id")
    rows = vectors.select("vec_id", "vector", *hashes).withColumn("place", F.dense_rank().over(by_vector))
    nodes = rows.where(F.col("place") <= keep).groupBy("h", "g").agg(
        F.any_value("vector").alias("vector"), F.sort_array(F.collect_set("vec_id")).alias("ids")
    )
    nodes = stored(nodes.select("h", F.size("vector").alias("dim"), "vector", "ids"), "nodes")
    shards = {r["dim"]: -(-r["n"] // shard_rows) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    many = F.lit(1)
    for dim, count in shards.items():
        many = F.when(F.col("dim") == dim, count).otherwise(many)

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("h").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order))
        vectors = np.array(rows.column("vector").to_pylist(), np.float64).reshape(len(rows), -1)
        ids = rows.column("ids").combine_chunks()
        graph = build(normalised(vectors))
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()], pa.int32()),
                "shard": pa.array([key[1].as_py()], pa.int64()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
                "links": pa.array([[x.tobytes() for x in graph.links]], pa.list_(pa.binary())),
                "entry": pa.array([graph.entry], pa.int32()),
            }
        )

    rows = nodes.withColumn("shard", F.pmod("h", many).cast("long"))
    graphs = rows.groupBy("dim", "shard").applyInArrow(
        one, "dim int, shard long, vectors binary, ids array<array<bigint>>, links array<binary>, entry int"
    )
    return stored(graphs, "graphs")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest vectors by cosine of every query: query_id, rank (from 1), vec_id, score.

    vectors and queries hold (vec_id, embedding). A query's own vec_id is no candidate;
    ties go to the smaller vec_id; with fewer candidates all are returned. Vectors that
    are null or zero, or hold null or non-finite components, take no part; nor do rows
    without vec_id. Vectors are compared with those of the same length. Rows with one
    vec_id and one vector count once; queries with one vec_id give the nearest over
    their vectors. Other columns are left out. The graph search is approximate; the
    scores are exact.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
        return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))

    graphs = index(clean(vectors), k + 1, shard_rows)
    asked = clean(queries).withColumn("dim", F.size("vector"))
    blocks = {r["dim"]: -(-r["n"] // QUERY_BLOCK) for r in asked.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    many = F.lit(1)
    for dim, count in blocks.items():
        many = F.when(F.col("dim") == dim, count).otherwise(many)
    packed = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), many))
    packed = packed.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "vector")).alias("asked"))
    shards = graphs.groupBy("dim").agg(F.max("shard").alias("last"))
    sent = packed.join(shards, "dim").withColumn("shard", F.explode(F.expr("sequence(0L, last)"))).select("dim", "shard", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = {n: whole.column(n)[i] for n in whole.schema.names}
                vectors = np.frombuffer(row["vectors"].as_buffer(), np.float64).reshape(-1, row["dim"].as_py())
                links = [np.frombuffer(x, np.int32).reshape(len(vectors), -1) for x in row["links"].as_py()]
                graph, unit, ids = Graph(links, row["entry"].as_py()), normalised(vectors), row["ids"].as_py()
                found = []
                for ask in row["asked"].as_py():
                    own, query = ask["vec_id"], np.array(ask["vector"], np.float64)
                    at = np.array([n for _, n in graph.search(unit, normalised(query[None])[0], ef)], int)
                    scored = zip(cosines(vectors[at], query).tolist(), at.tolist(), strict=True)
                    hits = [(-s, v) for s, n in sorted(scored, reverse=True)[: k + 1] for v in ids[n] if v != own]
                    found += [(own, v, -s) for s, v in sorted(hits)[:k]]
                columns = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)],
                    names=["query_id", "vec_id", "score"],
                )

    hits = graphs.join(sent, ["dim", "shard"]).mapInArrow(run, "query_id long, vec_id long, score double")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
