"""URL filters, clustering and resampling: against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.llm import clustering, resampling, url_filters
from pagemill.llm.queries import URL_RULES

# -- URL filters ---------------------------------------------------------------


def brute_judge(url, rules, listed):
    head, mark, rest = (url or "").partition("://")
    rest = rest if mark else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    labels = host.split(".")
    names = {".".join(labels[i:]) for i in range(len(labels))} - {""}
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (len(r[1] + r[2]), len(r[1])), default=None)
    held = any(n in listed for n in names if len(n) <= 253)
    verdict = best[0] if best else "block" if held else "allow"
    return host, path, best and best[1] + best[2], verdict, held


ODD_URLS = [
    None, "", "no scheme", "://", "http://", "http:///x", "HTTP://Sub.EXAMPLE.org/es/1?q#f", "http://example.org/en/12", "http://org/",
    "http://org", "http://notorg/", "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/?x", "http://listed.test?a/b", "x://y://z/w",
    "http://u:p@listed.test:80/", "http://sub.listed.test/a\nb", "http://a..listed.test/", "http://" + "a." * 300 + "listed.test/p",
    "http://" + "b" * 5000 + "/x", "http://" + "c" * 300 + ".listed.test", "http://İ.example.com/", "http://listed.test/" + "y" * 50000,
]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(1)
    urls = list(ODD_URLS)
    urls += [f"https://{rng.choice(['', 'www.', 'm.'])}h{rng.randrange(900)}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['de', 'fr', 'x'])}/" for _ in range(3000)]
    urls += ["http://hot.h1.net/"] * 1500
    rows = [(i, u, "x", "y") for i, u in enumerate(urls)] + [(None, "http://h2.net/", "x", "y"), (3, "http://", "x", "y")]
    return spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")


LISTED = ["listed.test", "hot.h1.net", *(f"h{i}.net" for i in range(0, 900, 3)), *(f"www.h{i}.com" for i in range(0, 900, 7)), "not.met.example"]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([(x,) for x in [*LISTED, "h0.net", None, ""]], "key string")


@pytest.mark.parametrize("max_bytes", [url_filters.MAX_BYTES, 64])
def test_urls_against_brute_force(spark, pages, listed, max_bytes):
    got = url_filters.judge(pages, URL_RULES, listed, max_bytes).collect()
    mine = Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["listed"]) for r in got)
    wanted = Counter((r["page_id"], *brute_judge(r["url"], URL_RULES, set(LISTED))) for r in pages.collect())
    assert mine == wanted
    assert {v for *_, v, _ in wanted} == {"allow", "block"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = random.Random(2)
    names = sorted({f"{rng.randrange(10**9)}.example" for _ in range(30000)})
    held = set(rng.sample(names, 9000))
    universe = spark.createDataFrame([(n, n in held) for n in names], "key string, listed boolean")
    made = url_filters.build(universe)
    assert len(made.levels) >= 3  # false positives were met, and encoded in turn
    assert sum(8 * n for n, _ in made.levels) < 9000 * 4
    rows = made.attach(universe, "words").select("key", made.holds(F.col("key"), F.col("words")).alias("found")).collect()
    assert {r["key"] for r in rows if r["found"]} == held


def test_cascade_without_listed_or_without_others(spark):
    for held in (False, True):
        made = url_filters.build(spark.createDataFrame([("a", held), ("b", held)], "key string, listed boolean"))
        rows = made.attach(spark.createDataFrame([("a",)], "key string"), "w")
        assert rows.select(made.holds(F.col("key"), F.col("w")).alias("found")).first()["found"] is held


def test_words_of_many_parts(spark, monkeypatch):
    monkeypatch.setattr(url_filters, "PART_WORDS", 16)
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    made = url_filters.build(universe)
    assert made.levels[0][0] > 64
    wrong = made.attach(universe, "w").where(made.holds(F.col("key"), F.col("w")) != F.col("listed"))
    assert wrong.count() == 0


def test_url_plan_has_neither_python_nor_joins(spark, pages, listed):
    made = url_filters.judge(pages, URL_RULES, listed)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Exchange", plan)


def test_url_rules_ties_and_empty_tables(spark, pages, listed):
    rules = (("block", "b.org", "/"), ("allow", "org", "/xy"), ("block", "org", "/x"), ("allow", "a.b.org", ""))
    rows = spark.createDataFrame([(1, "http://b.org/xyz"), (2, "http://c.org/xyz"), (3, "http://a.b.org"), (4, "http://c.org/xz")], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.judge(rows, rules, listed).collect()}
    assert got == {1: ("b.org/", "block"), 2: ("org/xy", "allow"), 3: ("a.b.org", "allow"), 4: ("org/x", "block")}
    assert url_filters.judge(pages.limit(0), rules, listed).collect() == []
    got = url_filters.judge(rows, (), listed.limit(0)).collect()
    assert {(r["rule"], r["verdict"], r["listed"]) for r in got} == {(None, "allow", False)}


# -- clustering ----------------------------------------------------------------


def brute_clusters(rows, dim, k, rounds, scale, seed):
    kept = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in last)


def cluster_rows(df):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int")


@pytest.mark.parametrize("k,dim,most", [(5, 4, 1.0), (1, 3, 1.0), (7, 2, 100000.0), (300, 4, 1.0)])
def test_clusters_against_brute_force(spark, monkeypatch, k, dim, most):
    monkeypatch.setattr(clustering, "CHUNK_ROWS", 32)
    rng = random.Random(k)
    rows = [(i, [rng.gauss(0, 0.2) * most + (i % 3) * most / 4 for _ in range(dim)]) for i in range(220)]
    rows += [(1000 + i, [0.5] * dim) for i in range(60)]  # a hot vector
    rows += [(5, rows[5][1]), (None, [0.0] * dim), (2000, None), (2001, [0.0] * (dim + 1)), (2002, []), (2003, [None] + [0.0] * (dim - 1))]
    rows += [(2004, [float("nan")] * dim), (2005, [float("inf")] * dim), (2006, [-0.0] * dim), (2007, [-1e-300] * dim)]
    got = cluster_rows(clustering.cluster(vectors_of(spark, rows), dim, k, 6, 1024, 3))
    assert got == brute_clusters(rows, dim, k, 6, 1024, 3)


def test_cluster_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(40)] + [(100 + i, [0.5, 0.0]) for i in range(9)]
    for seed in range(4):
        got = cluster_rows(clustering.cluster(vectors_of(spark, rows), 2, 4, 3, 1024, seed))
        assert got == brute_clusters(rows, 2, 4, 3, 1024, seed)


def test_cluster_of_nothing(spark):
    df = vectors_of(spark, [(1, [0.0, 1.0]), (None, None)])
    assert clustering.cluster(df, dim=3).collect() == []
    assert clustering.cluster(df.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # Components whose squared distances would not fit a long take no part.
    assert [r["vec_id"] for r in clustering.cluster(vectors_of(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])]), dim=2).collect()] == [2]


def test_large_components_are_exact():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (4, 64))
    wanted = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
    assert clustering.squared_distances(v, c).tolist() == wanted


def test_bounds_spare_measurements_and_lose_nothing():
    """Total displacement, not summed drifts: a centroid that comes back frees its vectors from new measurements."""
    rng = np.random.default_rng(0)
    centres = rng.integers(-2000, 2000, (6, 8))
    vectors = (centres[rng.integers(0, 6, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    history, state, measured, summed = [centres.astype(np.int64)], None, [], []
    drift = np.zeros(6)
    for t in range(12):
        state, n = clustering.assign(vectors, state, np.stack(history))
        measured.append(n)
        exact = clustering.squared_distances(vectors, history[-1])
        assert (state[0] == exact.argmin(1)).all()
        move = rng.integers(150, 200, (6, 8)) * (1 if t % 2 == 0 else -1)
        drift += np.sqrt((move * move).sum(1))
        history.append(history[-1] + move)
        summed.append(drift.max())
    assert measured[0] == 3000 and sum(measured[1:]) < 3000
    back = clustering.displacements(np.stack(history))[0][0].max()
    assert summed[-1] > 5 * back


def test_rounds_move_no_vectors(spark):
    rows = clustering.in_chunks(clustering.whole_vectors(vectors_of(spark, [(i, [i / 100, 1.0]) for i in range(99)]), 2, 1024), 2)
    whole = clustering.Bucketed(rows.repartition(3, "chunk"), 3)
    state = clustering.Bucketed(clustering.states(whole.rows, 2, np.array([[[0, 0], [900, 900]]])), 3)
    plan = clustering.joined(whole.rows, state.rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and "ShuffledHashJoin" in plan
    whole.drop(), state.drop()
    assert not spark.catalog.tableExists(whole.name)


# -- resampling ----------------------------------------------------------------

BRUTE_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute_features(text, longest):
    words = BRUTE_WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def brute_resample(docs, target, longest, buckets, percent, shortest, seed):
    found = [(i, *brute_features(t, longest)) for i, t in docs]
    s = Counter(h % buckets for _, _, hs in found for h in hs)
    t = Counter(h % buckets for x in target for h in brute_features(x, longest)[1])
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    rows = []
    for i, n, hs in found:
        weight, score = sum(gain[h % buckets] for h in hs), None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(hs), weight, score, None, n])
    able = sorted((r for r in rows if r[5] >= shortest and r[3] is not None), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return Counter(tuple(r[:5]) for r in rows)


@pytest.mark.parametrize("longest,buckets", [(1, 100), (1, 10000), (2, 500), (3, 64)])
def test_resampling_against_brute_force(spark, docs_of, odd, prose, longest, buckets):
    texts = [prose(i, n, 30) for i, n in enumerate([0, 1, 3, 19, 20, 21, 50, 400] * 12)]
    texts += [prose(5, 40)] * 50  # equal texts, other ids
    texts += ["Ünï CÖDE 日本 word's end\x00null İI " * 9, "A" * 40000, "a " * 30000]
    docs = docs_of(texts, [3 * i % 1000 for i in range(len(texts))]).unionByName(odd)
    target = spark.createDataFrame([(t,) for t in [prose(1, 300, 5), None, "", "mill1 river2"]], "text string")
    args = (longest, buckets, 30, 20, 2024)
    got = resampling.resample(docs, target, *args).collect()
    wanted = brute_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], *args)
    assert Counter(tuple(r) for r in got) == wanted


def test_runs_never_cross_texts_or_blocks():
    texts = ["a b c", None, "", "d", "e f", "\0", "g\0h"]
    for at_once in (1, 2, 3, 100):
        for longest in (1, 2, 3, 4):
            got = Counter()
            for n, owners, hashes in resampling.features(pa.array(texts, pa.string()), longest, at_once):
                got.update(zip([n] * len(owners), owners.tolist(), hashes.tolist(), strict=True))
            wanted = Counter()
            for i, t in enumerate(texts):
                words = re.findall("[a-z]+", t or "")
                for n in range(1, longest + 1):
                    wanted.update((n, i, zlib.crc32(" ".join(words[j : j + n]).encode())) for j in range(len(words) - n + 1))
            assert got == wanted


def test_resampling_of_empty_tables(none, docs_of, spark):
    empty = spark.createDataFrame([], "text string")
    assert resampling.resample(none, empty).collect() == []
    got = resampling.resample(docs_of(["one two"] * 3), empty, shortest=1, percent=100).collect()
    assert sorted(r["rank"] for r in got) == [1, 2, 3]
    assert resampling.resample(none, docs_of(["x"])).collect() == []
