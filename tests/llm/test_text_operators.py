"""BPE, lines, licences, packing: against libraries, SQL and brute force."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe, licences, lines, packing, queries

public = pytest.importorskip("public_tokenizers")
RANKS = public.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def pairs(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


# -- BPE ---------------------------------------------------------------------

ENCODING = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab's'reve'lltdm  \n\t 　é中1२,.’!́\U0001f600"), max_size=60), max_size=5))
def test_slices_and_merges_as_the_library(texts):
    got = bpe.encode_texts(texts, RANKS)
    assert [g.tolist() for g in got] == [ENCODING.encode_ordinary(t) for t in texts]


def test_every_code_point_and_long_runs():
    texts = [f"a{chr(c)}{chr(c)} 1{chr(c)}" for c in range(0, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts += ["a" * 20000, " " * 9000, "'s" * 500, "!" * 5000 + "x", "ab" * 3000 + "'ll"]
    got = bpe.encode_texts(texts, RANKS)
    wrong = [t[:20] for t, g, e in zip(texts, got, ENCODING.encode_ordinary_batch(texts), strict=True) if g.tolist() != e]
    assert not wrong, wrong[:5]


def test_encode_decode_and_offsets(spark, odd, none, reference):
    coded = bpe.encode(odd, RANKS)
    rows = bpe.decode(coded, RANKS).collect()
    texts = [r.text for r in odd.collect()]
    assert [r.doc_id for r in rows] == [r.doc_id for r in odd.collect()]
    for r, t in zip(rows, texts, strict=True):
        data = (t or "").encode()
        assert bytes(r.decoded) == data and list(r.ids) == reference.encode_ordinary(t or "")
        ends = [*r.starts[1:], len(data)] if r.ids else []
        assert all(data[a:b] == reference.decode_single_token_bytes(i) for i, a, b in zip(r.ids, r.starts, ends, strict=True))
    both = [(r.ids, r.starts, bytes(r.decoded)) for r in bpe.round_trip(odd, RANKS).collect()]
    assert both == [(r.ids, r.starts, bytes(r.decoded)) for r in rows]
    assert bpe.encode(none, RANKS).count() == 0 and bpe.round_trip(none, RANKS).count() == 0


# -- lines -------------------------------------------------------------------


def brute_lines(rows, shortest=40, documents=5):
    def key(x):
        x = x.strip(" \t\n\x0b\x0c\r").encode().lower().decode()
        return x if len(x) >= shortest else None

    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if key(x):
                    held[key(x)].add(i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or not key(x) or len(held[key(x)]) < documents or max(held[key(x)]) == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


# All repeated lines hot, some of them, none of them.
@pytest.mark.parametrize("hot", [1000, 2, 0])
def test_lines_against_brute_force(docs_of, none, prose, monkeypatch, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    common = ["  Common line of forty and more code points, HERE  ", "Übrigens ist dies eine Zeile mit Umlauten, die oft steht\t"]
    texts, ids = [], []
    for i in range(40):
        own = [prose(i * 10 + j, 8) for j in range(4)]
        if i % 2:
            own.insert(1, common[0].upper() if i % 3 else common[0])
        if i % 5 == 0:
            own += [common[1], common[1]]
        if i < 4:
            own.append("four documents hold this line of more than forty letters")
        texts.append("\n".join(own))
        ids.append(i)
    texts += [None, "", "short\nshort", common[0], texts[1], common[0] + "\n" + common[0]]
    ids += [100, 101, 102, None, 1, 103]
    docs = docs_of(texts, ids)
    got = sorted(map(tuple, lines.dedup_lines(docs).collect()), key=str)
    assert got == sorted(brute_lines(list(zip(ids, texts, strict=True))), key=str)
    assert lines.dedup_lines(none).count() == 0
    kept = lines.dedup_lines(docs, carry=True).select("row.*").columns
    assert kept == [c for c in docs.columns if c != "text"]


# -- licences ----------------------------------------------------------------


def test_licence_forms(spark, odd, none, docs_of):
    known = spark.createDataFrame([("MIT", "Released under the MIT License."), ("L", "The sub-licence\nhttp://x.org & more"), ("B", "  ")], "licence string, text string")
    texts = [
        "RELEASED under the M.I.T. licence", "released   under the mit licence!!", "Copyright (c) 2020 A\nReleased under the\nMIT License",
        "text\n  Released under the MIT License. \nmore", "the sublicense https://x.org and more", "Released under the MIT License. é", None, "",
    ]
    got = pairs(licences.scan(docs_of(texts), known).orderBy("doc_id"))
    assert [got[i][0] for i in range(8)] == [None, "MIT", "MIT", None, "L", None, None, None]
    assert got[3][1:] == ("MIT", 1) and got[1][1:] == ("MIT", 1) and got[2][1:] == ("", 0) and got[7][1:] == ("", 0)
    assert licences.scan(odd, known).count() == len({r.doc_id for r in odd.collect()})
    assert licences.scan(none, known).count() == 0
    plan = licences.scan(odd, known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_licences_and_wrapped_notices(spark, docs_of, tmp_path):
    import textwrap

    from pagemill.llm import known_licences

    mit = known_licences.FOLDER.joinpath("MIT.txt").read_text()
    body = mit[mit.index("Permission") :]
    bsd = known_licences.FOLDER.joinpath("BSD-3-Clause.txt").read_text()
    apache = f"{known_licences.APACHE} {known_licences.APACHE_TERMS}"
    texts = [
        mit.replace("<year> <copyright holders>", "2019 Ann Miller"),
        "Some words before.\n\n" + mit + "\nand some after",
        *("first line\n" + "\n".join(textwrap.wrap(" ".join(body.split()), width)) + "\nlast line" for width in (37, 60, 120)),
        "code()\n" + "\n".join(f" * {x}" for x in textwrap.wrap(apache, 70)) + "\nmore()",
        "x\n" + bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ") + "y",
        "a\n// " + "\n// ".join(textwrap.wrap(known_licences.MPL.format("https://"), 60)) + "\nb",
        known_licences.FOLDER.joinpath("GPL-3.0.txt").read_text(),
        "Permission is hereby granted, free of charge, to no one\nat all",
        "z\n" + known_licences.BSD,
        'z\nLicensed under the Apache License, Version 2.0 (the "License");\nz',
    ]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = pairs(queries.op1_licence_scan(spark, str(tmp_path)))
    assert [got[i][0] for i in (0, 8, 1)] == ["MIT", "GPL-3.0", None]
    assert [got[i][1] for i in range(1, 5)] == ["MIT"] * 4 and got[9] == (None, "", 0)
    assert "Apache-2.0" in got[5][1] and "BSD-3-Clause" in got[6][1] and got[10][1] == "BSD" and got[11][1:] == ("Apache-2.0", 1)
    assert "MPL-2.0" in got[7][1]


# -- packing -----------------------------------------------------------------


def check_packing(rows, want, capacity):
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        of_doc[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    got = {}
    for d, found in of_doc.items():
        found.sort()
        assert [s for s, _, _ in found] == list(np.cumsum([0, *(len(i) for _, i, _ in found)])[:-1])
        got[d] = [i for _, ids, _ in found for i in ids]
        assert {n for _, _, n in found} == {len(got[d])}
    assert got == want
    padding = 0
    for found in of_sequence.values():
        found.sort()
        assert [o for o, _ in found] == list(np.cumsum([0, *(n for _, n in found)])[:-1])
        total = sum(n for _, n in found)
        assert total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding


@pytest.mark.parametrize("capacity,grid", [(64, 8), (2048, 32)])
def test_packing(docs_of, none, prose, reference, capacity, grid):
    texts = [prose(i, 1 + i * i % 97) for i in range(120)] + [prose(500, 9000), None, "", "x"]
    docs = docs_of(texts)
    rows = packing.pack(docs, RANKS, end_id=1, capacity=capacity, grid=grid).collect()
    want = {i: [*reference.encode_ordinary(t or ""), 1] for i, t in enumerate(texts)}
    assert check_packing(rows, want, capacity) == 0
    assert packing.pack(none, RANKS).count() == 0


def test_packing_reads_added_tokens():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    own, added = Tokenizer.from_file(path), packing.added_tokens(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|>\n y", "<|endoftext|", None, "", "plain words 12"]
    got = packing.encode_with(texts, public.path("byte_bpe_50k.tiktoken"), added)
    assert [g.tolist() for g in got] == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got[0].tolist() == [64, 50256, 65]


def test_layout_holds_every_piece_once():
    rng = np.random.default_rng(4)
    histogram = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, 97), 60, replace=False), rng.integers(1, 400, 60), strict=True)}
    slots = packing.layout(histogram, 256)
    for n, c in histogram.items():
        spans = sorted((s.first_rank, s.end_rank) for s in slots if s.length == n)
        assert [a for a, _ in spans] == [0, *(b for _, b in spans[:-1])] and spans[-1][1] == c
    used = defaultdict(int)
    for s in slots:
        for k in range((s.end_rank - s.first_rank) // s.per_sequence):
            used[s.first_sequence + k * (len(s.cuts) - 1)] += s.per_sequence * s.length
    total = sum(n * c for n, c in histogram.items())
    assert len(used) <= -(-total // 256) * 1.02 + 2 and max(used.values()) <= 256


def test_knapsack_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(30):
        lengths, values = rng.integers(3, 20, 4).tolist(), rng.random(4)
        taken = packing.knapsack(lengths, values, 40)
        assert sum(n * k for n, k in zip(lengths, taken, strict=True)) <= 40
        best = np.zeros(41)
        for room in range(1, 41):
            best[room] = max([best[room - 1], *(best[room - n] + v for n, v in zip(lengths, values, strict=True) if n <= room)])
        assert abs(sum(v * k for v, k in zip(values, taken, strict=True)) - best[40]) < 1e-9


# -- queries with SQL --------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, data), con.sql(queries.ORACLES[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    want = theirs.select(*columns).fetchall()
    assert sorted(map(tuple, mine.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_digest_queries(spark, data, reference):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op9_byte_bpe(spark, data).collect():
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    ids = {d: [*own.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    pieces = queries.op5_packing(spark, data).collect()
    for r in pieces:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert sum(r.length for r in pieces) == sum(map(len, ids.values()))
