"""Quality rules: word statistics of whole texts, and a line model that decides the rest.

Every line of a text is tagged content or boilerplate by a linear-chain conditional
random field, decoded by Viterbi. The share of a text's characters in content lines
decides whether it is kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import crf
from pagemill.llm.common import chunks, narrow, row_schema, sampled_ids

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
DIGITS = re.compile(r"[0-9]")
#: Upper ends of the bins of each line feature; a feature has one bin more than ends.
BINS = (
    ("symbols a word", (0.01, 0.1, 0.3, 0.6)),
    ("upper-case letters a character", (0.02, 0.1, 0.3, 0.5)),
    ("repeated words", (0.01, 0.3, 0.5, 0.7)),
    ("words", (0.5, 2.5, 5.5, 12.5)),
    ("characters a word", (2.5, 4, 8, 12)),
    ("exclamation marks a word", (0.01, 0.3, 0.8)),
    ("digits a character", (0.01, 0.1, 0.3)),
    ("bars a word", (0.01, 0.2, 0.4)),
    ("ends a sentence", (0.5,)),
    ("seen before in the text", (0.5,)),
)
ENDS = [np.array(ends) for _, ends in BINS]
FIRST = np.cumsum([0, *(len(e) + 1 for e in ENDS)])
N_FEATURES = int(FIRST[-1])
SAMPLE, SAMPLE_LINES = 1500, 150
LEAST_CONTENT = 0.5


def line_features(lines: list[str]) -> np.ndarray:
    """Numbers of the weight rows of every line: lines x features."""
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, size = max(1, len(words)), max(1, len(line))
        symbols = sum(map(line.count, "#*$%&|<>"))
        last = line.rstrip()[-1:]
        rows.append(
            (
                symbols / n,
                len(UPPER.findall(line)) / size,
                1 - len(set(words)) / n if len(words) > 5 else 0,
                len(words),
                size / n,
                line.count("!") / n,
                len(DIGITS.findall(line)) / size,
                line.count("|") / n,
                last in ".!?…。" and last != "",
                bool(words) and line in seen,
            )
        )
        seen.add(line)
    values = np.array(rows, float).reshape(len(rows), len(BINS))
    out = np.empty(values.shape, np.int64)
    for f, ends in enumerate(ENDS):
        out[:, f] = FIRST[f] + np.searchsorted(ends, values[:, f])
    return out


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    white = len(data) - len(data.translate(None, WHITE))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, repeated = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            repeated += bool(line.split())
        seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    times = Counter(windows)
    covered, end = 0, 0
    if len(times) < len(windows):
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
    return len(words), len(text) - white, symbols, repeated, covered


def fit_lines(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> crf.Model:
    """Line model from labelled documents: labels(doc_id, quality), 1 for good and 0 for bad.

    The training sample is bounded: of each label sample / 2 documents, those with the
    least hash of their id, and of each document as many lines at most. A line takes
    its document's label. Null labels and ids are passed over; without any labelled
    document the model is empty, and everything is content.
    """
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where(
        "doc_id IS NOT NULL AND quality IN (0, 1)"
    )
    chosen = {}
    for quality in (0, 1):
        chosen |= dict.fromkeys(sampled_ids(known.where(F.col("quality") == quality), "doc_id", sample // 2), quality)
    if not chosen:
        return crf.empty(N_FEATURES, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features((t or "").split("\n")[:lines]).ravel() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "features"]
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.where(F.col("doc_id").isin(list(chosen))).mapInArrow(run, "doc_id long, features array<int>")
    found = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["features"]))
    sequences = [np.array(r["features"], np.int64).reshape(-1, len(BINS)) for r in found]
    tags = [np.full(len(s), chosen[r["doc_id"]]) for r, s in zip(found, sequences, strict=True)]
    return crf.fit(sequences, tags, N_FEATURES, 2)


def label_lines(
    docs: DataFrame, model: crf.Model, least_content: float = LEAST_CONTENT, carry: bool = False
) -> DataFrame:
    """Statistics, line tags and verdict of every row of docs(doc_id, text).

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    content_share, content array<boolean> (a tag per line), kept. Words are runs
    without ASCII white space; a null text has none, its one line is empty. A text
    without visible lines has the share 0. Ties between tags are content under the
    empty model. Null ids are kept, repeated rows give repeated rows, other columns
    are left out; with carry they come along as row, and text as it is.
    """
    blank = not model.weights.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                split = [t.split("\n") for t in texts]
                features = [line_features(x) for x in split]
                tags = [np.ones(len(x), np.int64) for x in split] if blank else crf.viterbi(model, features)
                stats = list(zip(*map(statistics, texts), strict=True)) if texts else [()] * 5
                shares, failed, kept = [], [], []
                for lines, tag, words, repeats in zip(split, tags, stats[0], stats[4], strict=True):
                    size = np.array([len(x.strip()) for x in lines])
                    shares.append(float(size[tag == 1].sum() / size.sum()) if size.sum() else 0.0)
                    failed.append(words < 50 or 100 * repeats > 50 * words)
                    kept.append(not failed[-1] and shares[-1] >= least_content)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        *(pa.array(s, pa.int64()) for s in stats),
                        pa.array(failed, pa.bool_()),
                        pa.array(shares, pa.float64()),
                        pa.array([t == 1 for t in tags], pa.list_(pa.bool_())),
                        pa.array(kept, pa.bool_()),
                        *((batch.column("text"), batch.column("row")) if carry else ()),
                    ],
                    names=[
                        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        "base_failed", "content_share", "content", "kept", *(("text", "row") if carry else ()),
                    ],
                )

    rows = narrow(docs, carry)
    return rows.mapInArrow(
        run,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, content_share double, content array<boolean>, kept boolean"
        + (", text string" if carry else "")
        + row_schema(rows),
    )
