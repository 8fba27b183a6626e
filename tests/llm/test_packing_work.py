"""Work of op5: a slice is looked up once in a batch, pieces are cut without a step per piece."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest

from pagemill.llm import bpe, packing

RANKS = public.path("byte_bpe_50k.tiktoken")


def test_a_slice_is_looked_up_once_in_a_batch(monkeypatch, prose):
    asked = Counter()
    look_up = bpe.Coder.ids_of

    def counted(self, slices):
        asked.update(slices)
        return look_up(self, slices)

    monkeypatch.setattr(bpe.Coder, "ids_of", counted)
    texts = [prose(1, 300, 20)] * 40 + ["\0 a\0", "ü " * 500, None]
    got = bpe.encode_texts(texts, RANKS)
    assert len(got) == len(texts) and all(np.array_equal(ids, got[0]) for ids in got[:40])
    assert set(asked.values()) == {1} and len(asked) < 1000


def test_merging_in_step_as_one_by_one(monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(bpe, "TOGETHER", 7)
    coder = bpe.Coder(RANKS)
    sets = [b"ab", b"0123456789abcdef", b"etaoin shrdlu", bytes(range(256))]
    words = list({bytes(rng.choices(rng.choice(sets), k=rng.randint(1, 60))) for _ in range(3000)})
    for _ in range(2):  # merged, then from the cache
        for word, ids in zip(words, coder.ids_of(words), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == bpe.merge(word, coder.ranks), word


@pytest.mark.parametrize("capacity,grid", [(2048, 32), (64, 8), (8, 8), (7, 3), (1, 1)])
def test_pieces_and_their_ranks(capacity, grid):
    rng = random.Random(capacity)
    sizes = np.array([1, grid, capacity, capacity + 1, 3 * capacity, *(rng.randint(1, 5 * capacity) for _ in range(200))])
    doc, start, length = packing.cut_pieces(sizes, capacity, grid)
    want = []
    for i, n in enumerate(sizes.tolist()):
        full = n - n % capacity
        cuts = sorted({*range(0, full + 1, capacity), full + n % capacity // grid * grid, n})
        want += [(i, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert list(zip(doc.tolist(), start.tolist(), length.tolist(), strict=True)) == want
    seen, before = np.zeros(capacity + 1, np.int64), Counter()
    for half in (length[: len(length) // 2], length[len(length) // 2 :]):
        for n, rank in zip(half.tolist(), packing.ranks_within(half, seen).tolist(), strict=True):
            assert rank == before[n]
            before[n] += 1
