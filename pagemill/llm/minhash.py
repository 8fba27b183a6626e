"""Near duplicates by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash gives every element of a set a random permutation of the signature
slots; slot p[j] is offered the value j + r_j, and each slot keeps its least offer.
The values of one element are correlated over the slots, which lowers the variance
of the estimate. Offers of step j lie in [j, j + 1), so a set is finished at the
first step that leaves no slot open: the later steps cannot change it. Here all
sets of a chunk take step j at once.

Sets that are equal share one representative. Representatives that agree on a band
of rows meet in a bucket; each is checked against one centre of its bucket on the
full sets, which finds large groups without listing their pairs. What a bucket then
still holds in different components is compared in bounded blocks. Components come
from alternating large-star and small-star steps, the union-find of edge tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import chunks, stored

BANDS, ROWS = 32, 5  # a pair at similarity 0.8 misses all bands with probability 3e-6
SLOTS = BANDS * ROWS
BLOCK = 256
# Representatives whose sketches agree on less are not verified: 4 sigma below 0.8.
SKETCH_SHARE = 0.67
CACHE_WORDS = 300_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Word to its 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text.

    Words are maximal runs without ASCII white space, A-Z lower-cased. A text of fewer
    words is one shingle; one without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.zeros(len(found) - n + 1, np.uint64)
    for k in range(n):
        out = mix(out * GOLDEN + hashed[k : len(out) + k])
    return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """Signatures (sets x slots) of sets of 64-bit elements; the rows of empty sets mean nothing."""
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    permutation = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    active = np.arange(len(elements))
    with np.errstate(over="ignore"):
        for j in range(slots):
            if not len(active):
                break
            drawn = mix(elements[active] + GOLDEN * np.uint64(j + 1))
            k = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
            slot = permutation[active, k]
            permutation[active, k] = permutation[active, j]
            offer = (np.uint64(j) << np.uint64(32)) | (drawn >> np.uint64(32))
            np.minimum.at(out, owner[active] * slots + slot, offer)
            open_sets = (out.reshape(len(sets), slots) >> np.uint64(32) > np.uint64(j)).any(axis=1)
            active = active[open_sets[owner[active]]]
    return out.reshape(len(sets), slots)


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    bands = signatures.shape[1] // rows
    with np.errstate(over="ignore"):
        key = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN), (len(signatures), 1))
        for r in range(rows):
            key = mix(key * GOLDEN + signatures[:, r::rows])
    return key.view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands, sketch) of every row; the last three null for empty sets.

    digest names the set; sketch holds the low byte of every slot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 19):
                sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
                found = super_minhash(sets)
                keys = band_keys(found)
                low = found.astype(np.uint8)
                full = [len(s) > 0 for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if ok else None for s, ok in zip(sets, full, strict=True)], pa.binary()),
                        pa.array([k if ok else None for k, ok in zip(keys, full, strict=True)], pa.list_(pa.int64())),
                        pa.array([x.tobytes() if ok else None for x, ok in zip(low, full, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def hashed_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles): the sorted hashes of every row as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def close_sets(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    short, long = (p, q) if len(p) <= len(q) else (q, p)
    if 100 * len(short) < percent * len(long):  # no intersection could do
        return False
    both = np.count_nonzero(long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short)
    return 100 * both >= percent * (len(p) + len(q) - both)


def as_set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("left"), batch.column("right"), strict=True)
            keep = [close_sets(as_set(x), as_set(y), percent) for x, y in both]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of links(a, b)."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct()
    edges, before = stored(edges, "links"), None
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        large = stored(large, "large-star")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        others = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        edges = stored(others.unionAll(least.select("v", F.col("m").alias("u"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(roots)


def stars(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member of a bucket and its centre, for members(key, rep, n).

    The centre is the member that meets most others in all its buckets. The text that
    a group was copied from is nearer to its copies than they are to each other, so
    it becomes the centre of most of their buckets.
    """
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    centre = members.join(met, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("id"))).alias("c"))
    pairs = members.join(centre, "key").select(F.col("rep").alias("a"), (-F.col("c.id")).alias("b"))
    return pairs.where("a <> b").distinct()


def promising(component: np.ndarray, size: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place, later places) of members in different components with fitting sizes and close sketches."""
    for i in range(len(component) - 1):
        rest = slice(i + 1, None)
        fit = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
        at = np.flatnonzero(fit & (component[rest] != component[i])) + i + 1
        if len(at):
            at = at[(sketch[at] == sketch[i]).mean(axis=1) >= SKETCH_SHARE]
            if len(at):
                yield i, at


def groups_of(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.StructArray, tuple[np.ndarray, ...]]]:
    """Number, rows and (rep, component, size, sketch) of every list of a batch."""
    lists = batch.column("rows")
    for g in range(len(lists)):
        rows = lists[g].values
        plain = tuple(rows.field(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "n_shingles"))
        sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint8).reshape(len(rows), -1)
        yield g, rows, (*plain, sketch)


def across(members: DataFrame, reps: DataFrame, sets: DataFrame, comps: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between members of a bucket that lie in different components.

    In a bucket, the members of its largest component are compared with the others, and
    the others among themselves. Both are dealt into blocks of about block members; a
    group holds two blocks. A first pass finds, by sketches, the members that are near
    any other of their group; only those meet again with their full sets. No pass lists
    pairs: the first gives members, the second links.
    """
    known = members.join(comps, members["rep"] == comps["node"], "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component")
    )
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.count("*").alias("parts"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("major")
    )
    blocks = f"(%s + {block - 1}) div {block}"
    mixed = mixed.where("parts > 1").select(
        "key",
        F.col("major.component").alias("major"),
        F.expr(blocks % "major.n").alias("majors"),
        F.expr(blocks % "(n - major.n)").alias("minors"),
    )
    rows = known.join(mixed, "key").withColumn("large", F.expr("component = major"))
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(rep), if(large, majors, minors))"))
    # i < 0: a block of the others with a block of the largest component; else two blocks of the others.
    groups = F.expr(
        "if(large, transform(sequence(0L, minors - 1), m -> struct(-1 - m AS i, own AS j)), "
        "concat(transform(sequence(0L, majors - 1), c -> struct(-1 - own AS i, c AS j)), "
        "transform(sequence(0L, minors - 1), m -> struct(least(own, m) AS i, greatest(own, m) AS j))))"
    )
    rows = rows.withColumn("g", F.explode(groups)).select("key", "g.i", "g.j", "rep", "component")
    rows = rows.join(reps.select("rep", "n_shingles", "sketch"), "rep")
    place = ("key", "i", "j")
    fields = ("rep", "component", "n_shingles", "sketch")
    groups = rows.groupBy(*place).agg(F.collect_list(F.struct(*fields)).alias("rows"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, rows, (_, component, size, sketch) in groups_of(batch):
                kept = np.zeros(len(rows), bool)
                for i, at in promising(component, size, sketch, percent):
                    kept[i] = True
                    kept[at] = True
                if kept.any():
                    own = rows.filter(pa.array(kept))
                    keys = [pa.array([batch.column(c)[g].as_py()] * len(own), pa.int64()) for c in place]
                    yield pa.RecordBatch.from_arrays([*keys, *(own.field(c) for c in fields)], names=[*place, *fields])

    kinds = "key long, i long, j long, rep long, component long, n_shingles long, sketch binary"
    found = groups.mapInArrow(near, kinds).join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    again = found.groupBy(*place).agg(F.collect_list(F.struct(*fields, "shingles")).alias("rows"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int]] = []
            for _, rows, (rep, component, size, sketch) in groups_of(batch):
                full = [as_set(x) for x in rows.field("shingles")]
                # Components that a link has joined need no second one.
                now = component.copy()
                for i, at in promising(component, size, sketch, percent):
                    for j in at.tolist():
                        if now[i] != now[j] and close_sets(full[i], full[j], percent):
                            out.append((int(rep[i]), int(rep[j])))
                            now[now == now[j]] = now[i]
            columns = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b"])

    return again.select("rows").mapInArrow(linked, "a long, b long")


def of_one_id(rows: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids whose rows differ in their sets, as (doc_id, rep) per set, and links (a, b) between those.

    An id is a key as a rule, so there are few; the first pass keeps the least and the
    greatest digest of an id only.
    """
    texts = rows.where("doc_id IS NOT NULL").select("doc_id", "digest")
    seen = texts.groupBy("doc_id").agg(
        F.min("digest").alias("low"), F.max("digest").alias("high"), F.count("*").alias("n"), F.count("digest").alias("full")
    )
    several = stored(seen.where("low <> high OR (full > 0 AND full < n)").select("doc_id"), "repeated-ids")
    sets = texts.where("digest IS NOT NULL").join(several, "doc_id", "left_semi").distinct()
    sets = stored(sets.join(reps.select("digest", "rep"), "digest").select("doc_id", "rep"), "sets-of-ids")
    least = sets.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return sets, sets.join(least, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Groups of docs(doc_id, text) whose shingle sets are similar, directly or in steps.

    One row per row of docs: doc_id, n_shingles (size of its set), component_id (the
    least doc_id reachable over pairs with 100 * intersection >= percent * union,
    itself included) and kept (doc_id is component_id). Null and empty texts have
    empty sets and are linked with nothing. Rows that share a doc_id are one node,
    linked by what any of them links; repeated rows, and empty ones beside others, are
    therefore kept or dropped together. A null doc_id is linked with nothing: component_id null, kept. Other
    columns are left out. percent should not be below 80: the bands are cut for that.
    """
    rows = stored(signed(docs, words), "signed")
    reps = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
    reps = stored(
        reps.agg(
            F.min("doc_id").alias("rep"),
            F.any_value("n_shingles").alias("n_shingles"),
            F.any_value("bands").alias("bands"),
            F.any_value("sketch").alias("sketch"),
        ),
        "representatives",
    )
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(keyed.join(buckets, "key").select("key", "rep", "n"), "members")
    needed = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sets = stored(hashed_sets(texts.join(needed, "doc_id", "left_semi"), words), "sets")
    sets_of_ids, same = of_one_id(rows, reps)
    links = stored(similar(stars(members), sets, percent).unionAll(same), "star-links")
    comps = components(links)
    more = stored(across(members.drop("n"), reps, sets, comps, percent), "cross-links")
    comps = components(links.unionAll(more))
    named = reps.select("digest", "rep").join(comps, F.col("rep") == F.col("node"), "left")
    named = named.select("digest", F.coalesce("component", "rep").alias("component"))
    by_id = rows.where("doc_id IS NOT NULL").join(named, "digest", "left")
    # All rows of an id are where its least set is, empty ones too.
    least = sets_of_ids.groupBy("doc_id").agg(F.min("rep").alias("node"))
    place = least.join(comps, "node", "left").select("doc_id", F.coalesce("component", "node").alias("place"))
    by_id = by_id.join(stored(place, "places-of-ids"), "doc_id", "left")
    out = by_id.select("doc_id", "n_shingles", F.coalesce("place", "component", "doc_id").alias("component_id"))
    lost = rows.where("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.unionAll(lost).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
