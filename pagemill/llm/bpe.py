"""Byte-level BPE: encoding with offsets, and decoding.

Text is cut into the slices of the GPT-2 splitting pattern without a regex. Every
code point is one of nine symbols of a small automaton (a look-ahead of at most
three code points is folded into the symbol). A symbol acts on the automaton as a
function from states to states; these functions form a small monoid, composing
two of them is one table look-up, and composition is associative. So the states
before all code points come from a blocked scan: all blocks are folded at once,
then the block results, then all blocks are replayed from their known states.
Slices are merged by rank once each and kept in a bounded cache.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import chunks

LETTER, NUMBER, OTHER, JOIN, LONE, SPACE, SHORT, LONG, BREAK = range(9)
# States: nothing open, or what the open slice is made of; CUT1 and CUT2 wait for
# one or two more letters of a contraction.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, JOINED, IN_SPACES, CUT1, CUT2 = range(8)
BLOCK = 64
CACHE_WORDS = 200_000
TOGETHER = 16_384  # slices merged in step


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a slice starts at this symbol."""
    if symbol == BREAK:
        return CLOSED, True
    if symbol == LETTER and state in (CUT1, CUT2):
        return (CLOSED if state == CUT1 else CUT1), False
    if symbol == JOIN:
        return JOINED, True
    if symbol == LONE:
        return CLOSED, True
    if symbol == SPACE:
        return IN_SPACES, state != IN_SPACES
    if symbol in (SHORT, LONG) and state not in (IN_OTHERS, JOINED):
        return (CUT1 if symbol == SHORT else CUT2), True
    inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(symbol, IN_OTHERS)
    return inside, state not in (inside, JOINED)


@lru_cache(maxsize=1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(function of each symbol, products, starts), the last two at function * 16 + function or symbol.

    A symbol starts a slice or not in the state to which the function before it takes CLOSED.
    """
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(9)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(8)), *symbols]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in symbols:
            fg = tuple(g[s] for s in f)
            if fg not in known:
                known[fg] = len(known)
                todo.append(fg)
    functions = list(known)
    table = np.zeros((16, 16), np.uint8)  # there are 15 functions
    for (i, f), (j, g) in product(enumerate(functions), enumerate(functions)):
        table[i, j] = known[tuple(g[s] for s in f)]
    starts = np.zeros((16, 16), bool)
    for (i, f), x in product(enumerate(functions), range(9)):
        starts[i, x] = _step(f[CLOSED], x)[1]
    return np.array([known[f] for f in symbols], np.uint8), table.reshape(-1), starts.reshape(-1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of every code point."""
    space = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)}
    space |= {0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    out[list(space)] = SPACE
    return out


def _symbols(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Automaton symbols of code points; ends holds the place of the BREAK after each text."""
    kind = _classes()[points]
    kind[ends] = BREAK
    space = kind == SPACE
    before_word = np.zeros(len(kind), bool)
    before_word[:-1] = space[:-1] & ~space[1:] & (kind[1:] != BREAK)
    kind[before_word] = np.where(points[before_word] == 0x20, JOIN, LONE)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[kind[quote] == OTHER]
    if len(quote):
        ahead = np.zeros((2, len(quote)), points.dtype)
        for k in (0, 1):
            at = quote + 1 + k
            ok = at < len(points)
            ahead[k, ok] = np.where(kind[at[ok]] == LETTER, points[at[ok]], 0)
        one = np.isin(ahead[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            two |= (ahead[0] == ord(a)) & (ahead[1] == ord(b))
        kind[quote[one]] = SHORT
        kind[quote[two]] = LONG
    return kind


def slice_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places where slices start, the BREAK places included.

    points: code points of texts, each followed by one filler; ends: the fillers' places.
    """
    functions, table, starts = _automaton()
    symbols = _symbols(points, ends)
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, BREAK, np.uint8)
    padded[:n] = symbols
    grid = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    step = functions[grid]
    whole = step[0].copy()
    for row in step[1:]:
        whole = table[whole << 4 | row]
    # Exclusive scan of the block results by doubling.
    before = np.concatenate([np.zeros(1, whole.dtype), whole[:-1]])
    shift = 1
    while shift < blocks:
        before[shift:] = table[before[:-shift] << 4 | before[shift:]]
        shift *= 2
    found = np.empty((BLOCK, blocks), bool)
    for j in range(BLOCK):
        found[j] = starts[before << 4 | grid[j]]
        before = table[before << 4 | step[j]]
    return np.flatnonzero(found.T.reshape(-1)[:n])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of least rank is merged, the leftmost of equals first."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 48:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks)
    rank = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            rank[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As merge, by a heap over a linked list: n log n for slices of any length."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, ahead = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < len(parts) and (r := ranks.get(parts[i] + parts[j])) is not None:
            heapq.heappush(heap, (r, i, len(parts[i]) + len(parts[j])))

    while heap:
        _, i, size = heapq.heappop(heap)
        if parts[i] is None or (j := after[i]) >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] < len(parts):
            ahead[after[j]] = i
        offer(i)
        if ahead[i] >= 0:
            offer(ahead[i])
    return [ranks[p] for p in parts if p is not None]


class Pairs:
    """(left id, right id) to the id of their union: a hash table in flat arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, union = [], [], []
        for piece, i in ranks.items():
            for k in range(1, len(piece)):
                a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    union.append(i)
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.none = max(ranks.values(), default=0) + 1
        self.bits = max(4, int(np.ceil(np.log2(4 * len(key) + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.none, np.int32)
        value, slot = np.array(union, np.int32), self._slot(key)
        while len(key):  # all keys of a round try their slot; one each gets it
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[free]
            placed = self.keys[slot] == key
            self.values[slot[placed]] = value[placed]
            key, value = key[~placed], value[~placed]
            slot = (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = self.values[slot]
        out[found != key] = self.none
        left_over = np.flatnonzero((found != key) & (found != -1))
        while len(left_over):  # places whose slot holds another key look at the next slot
            slot[left_over] = (slot[left_over] + 1) & (len(self.keys) - 1)
            at = slot[left_over]
            found = self.keys[at]
            hit = found == key[left_over]
            out[left_over[hit]] = self.values[at[hit]]
            left_over = left_over[~hit & (found != -1)]
        return out


class Coder:
    """Encoder of one rank file, with a bounded cache from slices to little-endian ids."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.sizes = np.fromiter(map(len, self.pieces), np.int32, len(self.pieces))
        self.pairs = Pairs(ranks)
        # Byte 256 stands for the blank beside a slice.
        self.of_byte = np.array([*(ranks[bytes([i])] for i in range(256)), self.pairs.none], np.int32)
        self.byte_pairs = self.pairs(np.repeat(self.of_byte, 257), np.tile(self.of_byte, 257)).astype(np.int64) << 6
        self.cache: dict[bytes, bytes] = {}

    def ids_of(self, slices: list[bytes]) -> list[bytes]:
        """The ids of every slice; slices differ."""
        found: list[bytes | None] = list(map(self.cache.get, slices))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            for i, ids in zip(missing, self._learn([slices[i] for i in missing]), strict=True):
                found[i] = ids
        return found

    def _learn(self, new: list[bytes]) -> list[bytes]:
        """Merges slices and keeps their ids; a full cache starts afresh."""
        short = [w for w in new if len(w) <= 48]
        groups = (short[i : i + TOGETHER] for i in range(0, len(short), TOGETHER))
        out = dict(zip(short, chain.from_iterable(map(self._merge_all, groups)), strict=True))
        if len(self.cache) + len(out) > CACHE_WORDS:
            self.cache.clear()
        self.cache.update(out)
        return [out[w] if len(w) <= 48 else np.array(merge(w, self.ranks), "<i4").tobytes() for w in new]

    def _merge_all(self, words: list[bytes]) -> list[bytes]:
        """merge() of slices of at most 48 bytes in step: each round does one merge in every open slice.

        A slice lies between two blanks, which no pair holds. Its parts know their
        neighbours by place; key is rank and place of the pair that starts at a part.
        """
        out: list[bytes] = [b""] * len(words)
        number = np.arange(len(words))
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        first = np.cumsum(size) - size
        place = np.arange(size.sum()) - np.repeat(first, size)
        alive = place > 0
        alive[first + size - 1] = False
        byte = np.full(len(place), 256)
        byte[alive] = np.frombuffer(b"".join(words), np.uint8)
        ids = self.of_byte[byte]
        key = np.full(len(place), self.pairs.none << 6)
        key[:-1] = self.byte_pairs[byte[:-1] * 257 + byte[1:]]
        key = key | place
        ahead, after = place - 1, place + 1
        while True:
            least = np.minimum.reduceat(key, first)
            is_open = least < self.pairs.none << 6
            if 2 * np.count_nonzero(is_open) <= len(number):  # ended ones leave together
                ended = np.repeat(~is_open, size)
                ends = np.cumsum(np.add.reduceat(alive, first, dtype=np.int64)[~is_open] * 4).tolist()
                raw = ids[ended & alive].astype("<i4").tobytes()
                for w, a, b in zip(number[~is_open].tolist(), [0, *ends], ends, strict=False):
                    out[w] = raw[a:b]
                if not is_open.any():
                    return out
                ids, key, alive, ahead, after = (x[~ended] for x in (ids, key, alive, ahead, after))
                number, size, least = number[is_open], size[is_open], least[is_open]
                first = np.cumsum(size) - size
                base = first
            else:
                base, least = first[is_open], least[is_open]
            at, union = least & 63, least >> 6
            left = base + at
            gone = base + after[left]
            right_at, before_at = after[gone], ahead[left]
            right, before = base + right_at, base + before_at
            ids[left] = union
            alive[gone] = False
            key[gone] = self.pairs.none << 6
            after[left], ahead[right] = right_at, at
            key[left] = self.pairs(union, ids[right]).astype(np.int64) << 6 | at
            key[before] = self.pairs(ids[before], union).astype(np.int64) << 6 | before_at


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def encode_flat(texts: list[str | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and how many each text has; null is the empty text.

    A slice that comes back is looked up once: Arrow numbers the different ones.
    """
    own = coder(path)
    texts = [t or "" for t in texts]
    joined = "\0".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    at = slice_starts(points, ends)
    stops = np.searchsorted(at, ends)
    raw = joined.encode("utf-8", "surrogatepass")
    if len(raw) > len(joined):  # from code points to bytes
        at = np.flatnonzero(np.frombuffer(raw, np.int8) >= -64)[at]
    offsets = pa.py_buffer(np.append(at, len(raw)).astype("<i8"))
    slices = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
    found = own.ids_of(slices.dictionary.to_numpy(zero_copy_only=False).tolist())
    known = np.frombuffer(b"".join(found), "<i4")
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    number = slices.indices.to_numpy()
    length = sizes[number]
    length[stops] = 0  # fillers are slices of their own and are passed over
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(length)])
    ids = known[np.repeat((np.cumsum(sizes) - sizes)[number] - total[:-1], length) + np.arange(total[-1])]
    return ids, np.diff(total[stops], prepend=0)


def encode_texts(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Ids of every text, an array each; null is the empty text."""
    ids, sizes = encode_flat(texts, path)
    ends = np.cumsum(sizes).tolist()
    return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def list_array(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One Arrow list per numpy array."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _encoded(batch: pa.RecordBatch, ranks_path: str) -> pa.RecordBatch:
    sizes = coder(ranks_path).sizes
    ids = encode_texts(batch.column("text").to_pylist(), ranks_path)
    starts = [np.cumsum(sizes[i], dtype=np.int32) - sizes[i] for i in ids]
    columns = [batch.column("doc_id"), list_array(ids, pa.int32()), list_array(starts, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts"])


def _decoded(batch: pa.RecordBatch, ranks_path: str) -> pa.RecordBatch:
    """Every id's bytes laid at its offset; they follow each other, so this is a join."""
    pieces, ids = coder(ranks_path).pieces, batch.column("ids")
    at, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
    found = [b"".join(map(pieces.__getitem__, flat[a:b].tolist())) for a, b in zip(at, at[1:], strict=False)]
    columns = [*(batch.column(n) for n in batch.schema.names), pa.array(found, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids array<int>, starts array<int>) of every row of docs(doc_id, text).

    starts holds the UTF-8 byte offset at which each id's bytes begin in the text.
    A null or empty text has no ids; a null doc_id is kept as it is; repeated rows
    give repeated rows; other columns are left out. The rank file must be readable
    on every executor under ranks_path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                yield _encoded(batch, ranks_path)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded with the column decoded binary: the bytes of its ids, joined at their offsets.

    Null ids decode to no bytes. The result of encode() gives back the text's UTF-8.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _decoded(batch, ranks_path)

    schema = encoded.drop("decoded").schema.add("decoded", "binary")
    return encoded.drop("decoded").mapInArrow(run, schema)


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """decode(encode(docs)) in one pass, a few texts at a time: ids need not leave the worker between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 19):
                yield _decoded(_encoded(batch, ranks_path), ranks_path)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, decoded binary")
