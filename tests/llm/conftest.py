import random

import pytest

WORDS = "mill river stone wheel flood cart village path lamp bread dough water night boat harbour pier bridge inn ford road".split()


@pytest.fixture(scope="session")
def prose():
    """Text of n made-up words from a seed."""

    def make(seed, n, most=4000):
        rng = random.Random(seed)
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(most)}" for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents from texts, with columns whose names an operator uses for its own results."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", "src0", len(t or ""), "x", 1, True) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, n_tokens int, kept boolean"
        )

    return make


ODD_TEXTS = [None, "", " \n\t ", "one", "same text again\nsame text again", "same text again\nsame text again", "ü" * 30000 + " \U0001f600 end", "a b\r\n\x0bc\x00d"]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Null, empty, blank, repeated and long texts; a null id and a repeated row."""
    ids = [*range(len(ODD_TEXTS) - 1), None, 3]
    return docs_of([*ODD_TEXTS, "one"], ids)


@pytest.fixture(scope="session")
def none(docs_of, spark):
    return docs_of(["x"]).limit(0)
