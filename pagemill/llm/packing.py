"""Packing of tokenised documents into fixed sequences: cutting stock by column generation.

A document of n tokens gives pieces of CAPACITY tokens, then a head whose length is
a multiple of GRID and a tail shorter than GRID. So pieces have about a hundred
lengths, whatever the corpus, and all the plan needs of the corpus is a histogram
of them. On that histogram a linear program over patterns (how many pieces of
each length one sequence holds) is solved by column generation: a knapsack dynamic
program prices patterns against the dual values. Patterns rounded down take most
pieces; a bounded knapsack lays out the few that are left. A sequence that stays
short of CAPACITY is cut into powers of two, which need no padding.

Pieces are ranked among those of their length. A rank names its sequence and offset
by arithmetic, so no sequence is ever collected.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.bpe import encode_flat
from pagemill.llm.common import chunks, stored

CAPACITY = 2048
GRID = 32


def knapsack(lengths: list[int], values: np.ndarray, capacity: int, limits: list[int] | None = None) -> list[int]:
    """How many of each length to take for the greatest value within capacity.

    Multiplicities are split into 1, 2, 4, ... and a rest, each taken or not.
    """
    best = np.zeros(capacity + 1)
    steps = []
    for i, length in enumerate(lengths):
        left = capacity // length if limits is None else min(limits[i], capacity // length)
        k = 1
        while left > 0:
            k = min(k, left)
            left -= k
            offer = best[: capacity + 1 - k * length] + k * values[i]
            taken = offer > best[k * length :] + 1e-12
            np.maximum(best[k * length :], offer, out=best[k * length :])
            steps.append((i, k, taken))
            k *= 2
    counts, room = [0] * len(lengths), capacity
    for i, k, taken in reversed(steps):
        if room >= k * lengths[i] and taken[room - k * lengths[i]]:
            counts[i] += k
            room -= k * lengths[i]
    return counts


def column_generation(lengths: list[int], counts: list[int], capacity: int, rounds: int = 2000) -> list[tuple[list[int], float]]:
    """Patterns with their shares in the least number of sequences that hold all pieces.

    The revised simplex over patterns; a pattern enters while the knapsack finds one
    worth more than a sequence at the present dual values.
    """
    m = len(lengths)
    basis = np.diag([float(capacity // x) for x in lengths])
    share = np.array(counts, float) / np.diag(basis)
    for _ in range(rounds):
        dual = np.linalg.solve(basis.T, np.ones(m))
        pattern = np.array(knapsack(lengths, np.maximum(dual, 0), capacity), float)
        if dual @ pattern <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, pattern)
        ratio = np.full(m, np.inf)
        up = change > 1e-9
        ratio[up] = share[up] / change[up]
        out = int(np.argmin(ratio))
        step = ratio[out]
        share = np.maximum(share - step * change, 0)
        share[out] = step
        basis[:, out] = pattern
    return [([int(round(v)) for v in basis[:, j]], float(share[j])) for j in range(m)]


@dataclass
class Slot:
    """Pieces of one length in the repeats of one pattern."""

    length: int
    first_rank: int
    end_rank: int
    per_sequence: int
    offset: int
    first_sequence: int
    cuts: list[int]  # where the layout is cut into sequences; [0, capacity] if it is one


def powers(total: int) -> list[int]:
    """Cuts of total into falling powers of two."""
    cuts = [0]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    return cuts


def layout(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for every piece of a histogram from length to count."""
    slots: list[Slot] = []
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    sequence = 0

    def lay(pattern: dict[int, int], times: int) -> None:
        nonlocal sequence
        total = sum(n * k for n, k in pattern.items())
        cuts = [0, capacity] if total == capacity else powers(total)
        offset = 0
        for n, k in sorted(pattern.items(), reverse=True):
            slots.append(Slot(n, used[n], used[n] + k * times, k, offset, sequence, cuts))
            used[n] += k * times
            left[n] -= k * times
            offset += k * n
        sequence += times * (len(cuts) - 1)

    if left.get(capacity):
        lay({capacity: 1}, left[capacity])
    lengths = sorted((n for n in left if n < capacity), reverse=True)
    if lengths:
        for pattern, share in column_generation(lengths, [left[n] for n in lengths], capacity):
            taken = {n: k for n, k in zip(lengths, pattern, strict=True) if k}
            if sum(n * k for n, k in taken.items()) == capacity:
                times = min([int(share + 1e-6), *(left[n] // k for n, k in taken.items())])
                if times:
                    lay(taken, times)
    while rest := [n for n in lengths if left[n]]:
        pattern = knapsack(rest, np.array(rest, float), capacity, [left[n] for n in rest])
        taken = {n: k for n, k in zip(rest, pattern, strict=True) if k}
        lay(taken, min(left[n] // k for n, k in taken.items()))
    return slots


def added_tokens(json_path: str) -> dict[str, int]:
    """Texts and ids of the added tokens in a tokenizer's JSON file."""
    with open(json_path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file).get("added_tokens", [])}


def encode_ended(texts: list[str | None], ranks_path: str, added: dict[str, int], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, end_id after each, and how many each text has with that.

    Texts are cut at the added tokens before; of those that start at one place the longest
    counts. So one id, of an added token or end_id, follows every part.
    """
    cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    parts: list[str] = []
    after: list[int] = []
    last = []
    for text in texts:
        own = cut.split(text or "") if cut and any(map((text or "").__contains__, added)) else [text or ""]
        parts += own[::2]
        after += [added[p] for p in own[1::2]]
        after.append(end_id)
        last.append(len(parts))
    ids, sizes = encode_flat(parts, ranks_path)
    ends = np.cumsum(sizes)
    ids = np.insert(ids, ends, np.array(after, ids.dtype)).astype("<i4", copy=False)
    through = np.concatenate([np.zeros(1, np.int64), ends + np.arange(1, len(parts) + 1)])
    return ids, np.diff(through[last], prepend=0)


def encode_with(texts: list[str | None], ranks_path: str, added: dict[str, int]) -> list[np.ndarray]:
    """Ids of every text, which is cut at the added tokens before."""
    ids, sizes = encode_ended(texts, ranks_path, added, 0)
    ends = np.cumsum(sizes).tolist()
    return [ids[a : b - 1] for a, b in zip([0, *ends], ends, strict=False)]


def cut_pieces(sizes: np.ndarray, capacity: int, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these sizes, in order."""
    full, left = sizes // capacity, sizes % capacity
    head = left // grid * grid
    kinds = full + (head > 0) + (left > head)
    doc = np.repeat(np.arange(len(sizes)), kinds)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(kinds) - kinds, kinds)
    past = place - full[doc]  # below 0: a piece of capacity
    is_head = (past == 0) & (head[doc] > 0)
    length = np.where(past < 0, capacity, np.where(is_head, head[doc], (left - head)[doc]))
    start = np.where(past < 0, place * capacity, (full * capacity)[doc] + np.where(is_head, 0, head[doc]))
    return doc, start, length


def ranks_within(values: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How often each value came before, in seen or here; seen counts on."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    count = np.bincount(values, minlength=len(seen))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - (np.cumsum(count) - count)[sorted_values] + seen[sorted_values]
    seen += count
    return out


def pieces(
    docs: DataFrame, ranks_path: str, end_id: int, capacity: int = CAPACITY, grid: int = GRID, added: dict[str, int] | None = None
) -> DataFrame:
    """Pieces of every document with their ids, counted within the task by length.

    part and rank_in_part hold only together with the table they are stored in: a
    task that runs again writes its whole file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                ids, sizes = encode_ended(batch.column("text").to_pylist(), ranks_path, added or {}, end_id)
                doc, start, length = cut_pieces(sizes, capacity, grid)
                # Pieces follow each other as the ids do, so they are ranges of one buffer.
                ends = pa.array(np.concatenate([np.zeros(1, np.int64), np.cumsum(4 * length)]), pa.int32())
                held = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, ends.buffers()[1], pa.py_buffer(ids)])
                rank = ranks_within(length, seen)
                columns = [batch.column("doc_id").take(pa.array(doc)), start, length, held, sizes[doc], np.full(len(doc), part), rank]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    kinds = pa.schema(
        [(n, pa.binary() if n == "ids" else pa.int64()) for n in ("doc_id", "start", "length", "ids", "doc_tokens", "part", "rank_in_part")]
    )
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, part long, rank_in_part long")


def pack(
    docs: DataFrame, ranks_path: str, end_id: int = 1, capacity: int = CAPACITY, grid: int = GRID, added: dict[str, int] | None = None
) -> DataFrame:
    """docs(doc_id, text) as sequences of at most capacity tokens.

    One row per piece: doc_id, start (tokens of its document before it), length, ids
    (binary, little-endian 32-bit), doc_tokens, sequence_id, offset. A document is the
    ids of its text, where added maps texts to ids of their own, and end_id; a null or empty text is end_id alone; a null doc_id is
    kept; repeated rows are packed each; other columns are left out. Within a sequence
    pieces lie without gaps from offset 0. An empty table gives an empty one. The
    driver gets the histogram of piece lengths: capacity / grid + grid rows at most.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, ranks_path, end_id, capacity, grid, added), "pieces")
    counts = cut.groupBy("part", "length").count()
    by_length = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("base"))
    # Stored, so that Spark knows its size: where that is small, the pieces do not move.
    base = stored(base, "bases")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    kinds = [(n, pa.int64()) for n in ("length", "first_rank", "end_rank", "per_sequence", "at", "first_sequence")]
    rows = [tuple(vars(s).values()) for s in layout(histogram, capacity)]
    columns = zip(*rows, strict=True) if rows else [()] * 7
    kinds.append(("cuts", pa.list_(pa.int32())))
    slots = spark.createDataFrame(pa.table([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds]))
    ranked = cut.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("rank_in_part"))
    placed = ranked.join(slots, "length").where("rank >= first_rank AND rank < end_rank")
    placed = placed.select(
        "doc_id", "start", "length", "ids", "doc_tokens", "cuts",
        F.expr("at + (rank - first_rank) % per_sequence * length").alias("at"),
        F.expr("first_sequence + (rank - first_rank) div per_sequence * (size(cuts) - 1)").alias("first"),
    )
    # A piece lies in every sequence of its layout that it overlaps: one, unless the layout is cut.
    parts = F.expr(
        "filter(transform(sequence(0, size(cuts) - 2), i -> named_struct('i', i, 'a', greatest(at, cuts[i]), "
        "'b', least(at + length, cuts[i + 1]), 'zero', cuts[i])), p -> p.a < p.b)"
    )
    return placed.withColumn("p", F.explode(parts)).select(
        "doc_id",
        F.expr("start + p.a - at").alias("start"),
        F.expr("p.b - p.a").alias("length"),
        F.expr("substr(ids, cast(4 * (p.a - at) + 1 as int), cast(4 * (p.b - p.a) as int))").alias("ids"),
        "doc_tokens",
        F.expr("first + p.i").alias("sequence_id"),
        F.expr("p.a - p.zero").alias("offset"),
    )
