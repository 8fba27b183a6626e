"""Secret scans: fixed patterns, and a token model that finds what they miss.

Every token (a run without ASCII white space) is tagged outside, begin or inside by a
linear-chain conditional random field over its shape, the three words before it, the
word after and features of the whole text. Shapes are read once per different token.
Where a token's own score for outside leads by more than any two moves could make up,
outside is part of every best path; Viterbi decodes the runs between such tokens,
which gives the tags of the whole chain.

The model learns from bounded windows of sampled texts. The fixed patterns label
them, and each window is told again with the cue of the pattern hidden: another
keyword, another form or none, and another kind of value, so that shape and context
are learned and not the keyword. Windows with harmless values in the same places
teach what to leave alone.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import crf
from pagemill.llm.common import chunks, narrow, row_schema, sampled_ids

# The patterns, in the order of their kinds, with the least length of
# the group that has to reach it.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
MODEL_KIND = "model"
ORDER = {k: i for i, k in enumerate([*(k for k, *_ in KINDS), MODEL_KIND])}

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WRAP = "\"'`()[]{}<>,;.:!?*#$%&|"
OUTSIDE, BEGIN, INSIDE = range(3)
SAMPLE, WINDOW = 1500, 24

# What people write before a secret.
HINTS = (
    "password passwd pwd pass passphrase passcode passwort kennwort secret token key apikey auth authorization bearer basic "
    "credential credentials login pin private signature"
).split()
HINT_WORDS = frozenset(HINTS)
HINT = re.compile("passw|passphrase|secret|token|credential|bearer|(?:api|access|private)_?key")
# What stands around the value in one token, as in name=value.
NAMED = re.compile(r"""^["'({\[]*([^\W\d][\w.-]*)["']?[:=]+["']?([^=:"'].*)$""", re.DOTALL)

# Fields of a token itself, each with a number of values, then those of its neighbourhood.
SHAPE_FIELDS = (("length", 8), ("alphabet", 14), ("digits", 5), ("changes", 6), ("unspeakable", 4), ("named", 4), ("quoted", 2), ("prefixed", 2))
PLACE_FIELDS = (("hint before", 4), ("sign before", 3), ("hint and sign", 2), ("alphabet and cue", 14 * 4), ("length and cue", 8 * 4), ("after", 3), ("odd tokens", 4), ("symbols", 3))
FIELDS = SHAPE_FIELDS + PLACE_FIELDS
FIRST = np.cumsum([0, *(n for _, n in FIELDS)])
N_FEATURES, N_SHAPE = int(FIRST[-1]), len(SHAPE_FIELDS)
ALPHABETS = [
    re.compile(p)
    for p in (
        r"[0-9]+", r"[0-9.,:/+()%-]+", r"[^\W\d_]?[^\W\d_A-Z]*", r"[A-Z][A-Z]+", r"[^\s@]+@[^\s@]+\.[^\s@]+|\w+://.*|www\..*", r"[0-9a-f]+", r"[0-9A-F]+",
        r"[0-9A-Z]+", r"[A-Za-z]+", r"[0-9a-z]+", r"[0-9A-Za-z]+", r"[0-9A-Za-z_.-]+", r"[0-9A-Za-z+/_=.-]+",
    )
]
CHANGES = re.compile(r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])")
UNSPEAKABLE = re.compile(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ0-9]{4,}")
PREFIX = re.compile(r"[A-Za-z]{2,6}[_-](?=[0-9A-Za-z_-]{12,}$)")
TYPES = 1 << 18


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of the fixed patterns, leftmost and without overlap in each kind."""
    out = []
    for kind, pattern, group, least in KINDS:
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]], s[2]))


def _bin(x: float, *ends: float) -> int:
    return bisect.bisect_right(ends, x)


SIZES = [_bin(n, 4, 8, 12, 16, 24, 32, 48) for n in range(49)]


def shape(token: str) -> tuple[int, ...]:
    """The shape fields of a token, then: its hint (2: it is one, 1: it holds one), the sign at its end, oddness and being plain."""
    core = token.strip(WRAP)
    lower = core.lower()
    is_hint = 2 if lower in HINT_WORDS else 1 if HINT.search(lower) or lower.rpartition("_")[2] in HINT_WORDS else 0
    last = token[-1:]
    tail = 0 if last not in "=:\"'" else 1 if token.rstrip("\"'")[-1:] == "=" else 2 if token.rstrip("\"'")[-1:] == ":" else 0
    quoted = token[:1] in "\"'`" and len(token) > 2
    if core.isalpha() and (core[1:].islower() or len(core) == 1):  # a common word
        return SIZES[min(len(core), 48)], 2, 0, 0, 0, 0, quoted, 0, is_hint, tail, 0, 1
    named = NAMED.match(token) if ("=" in token or ":" in token) and "://" not in token else None
    name, value = (named[1], named[2].strip(WRAP)) if named else ("", core)
    alphabet = next((i for i, p in enumerate(ALPHABETS) if p.fullmatch(value)), len(ALPHABETS))
    digits = sum(map(value.count, "0123456789")) / max(1, len(value))
    changes = len(CHANGES.findall(value))
    hard = 0 if alphabet == 2 else max(map(len, UNSPEAKABLE.findall(value)), default=0)
    hinted = bool(name) and (bool(HINT.search(name.lower())) or re.split("[_.-]", name.lower())[-1] in HINT_WORDS)
    return (
        SIZES[min(len(value), 48)], alphabet, _bin(digits, 0.01, 0.2, 0.5, 0.99), _bin(changes, 1, 2, 3, 6, 12), _bin(hard, 4, 6, 10),
        0 if not name else 3 if hinted else 2 if "=" in named[0] else 1, quoted, bool(PREFIX.match(value)),
        is_hint, tail, alphabet >= 5 and len(value) >= 8, alphabet in (1, 2) or len(value) < 4,
    )


class Types(dict):
    """Numbers of different tokens, with their shapes as columns."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((N_SHAPE + 4, 0), np.int32)

    def __missing__(self, token: str) -> int:
        self[token] = n = self.table.shape[1] + len(self.rows)
        self.rows.append(shape(token))
        return n

    def shapes(self) -> np.ndarray:
        """Fields x types."""
        if self.rows:
            self.table = np.concatenate((self.table, np.array(self.rows, np.int32).T), 1)
            self.rows = []
        return self.table


@dataclass
class Tokens:
    """All tokens of some texts, one after another: their types, the numbers of the weight rows of their
    neighbourhood, a column per field, and the first token of each text, and the end."""

    types: np.ndarray
    places: list[np.ndarray]
    starts: np.ndarray

    def rows(self, shapes: np.ndarray, chosen: slice | np.ndarray) -> np.ndarray:
        """Numbers of all weight rows of some tokens."""
        own = shapes[:N_SHAPE, self.types[chosen]] + FIRST[:N_SHAPE, None]
        return np.concatenate((own, np.stack([p[chosen] for p in self.places]))).T


def read(texts: list[str], types: Types) -> Tokens:
    words = [WORD.findall(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    n = int(starts[-1])
    ids = np.fromiter(map(types.__getitem__, itertools.chain.from_iterable(words)), np.int64, n)
    del words
    shapes = types.shapes()
    alphabet, named, size = (shapes[i][ids] for i in (1, 5, 0))
    hint, sign, odd, plain = (shapes[N_SHAPE + i][ids] for i in range(4))
    texts_of = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(n) - starts[texts_of]

    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        out[k:] = x[: max(0, n - k)]
        out[place < k] = 0
        return out

    next_to = before(hint, 1)
    hints = np.maximum(next_to, np.maximum(before(hint, 2), before(hint, 3)))
    signs = before(sign, 1)
    after = np.full(n, 2, np.int32)
    after[:-1] = 1 - plain[1:]
    after[starts[1:][sizes > 0] - 1] = 2
    both = (hints > 0) & (signs > 0)
    cue = np.where((named == 3) | both, 3, np.where(hints > 0, 2, (signs > 0) | (named > 0)))
    many = np.searchsorted([2, 5, 20], np.bincount(texts_of, odd, minlength=len(texts)), "right")
    symbols = np.array([_bin(sum(map(t.count, "#*$%&|<>{};=")) / max(1, len(t)), 0.01, 0.05) for t in texts], np.int64)
    columns = [np.where(next_to > 0, 3, hints), signs, both, alphabet * 4 + cue, size * 4 + cue, after, many[texts_of], symbols[texts_of]]
    return Tokens(ids, [c + f for c, f in zip(columns, FIRST[N_SHAPE:-1].tolist(), strict=True)], starts)


# -- training --------------------------------------------------------------------

LETTERS, CAPITALS, FIGURES = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
FORMS = (
    '{k} = "{v}"', "{k} = '{v}'", "{k} = {v}", "{k}: {v}", '{k}: "{v}"', "{k}={v}", '"{k}": "{v}",', "{k} : {v}", "{k} {v}", "my {k} is {v}", "{k} is: {v}",
    "export {K}={v}", "use {k}: {v}", *["{v}"] * 4,
)
NAMES = ("{k}", "{k}", "my_{k}", "db_{k}", "user_{k}", "client_{k}", "{k}_id", "x-{k}")
PLAIN_NAMES = "name title size color date value status version author note total level part kind place".split()


def drawn(rng: random.Random, alphabet: str, least: int, most: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


def secret_value(rng: random.Random, words: list[str]) -> tuple[str, bool]:
    """A made-up secret, and whether it shows without a cue."""
    kind = rng.randrange(9)
    if kind == 0:
        return drawn(rng, "0123456789abcdef", 20, 64), True
    if kind == 1:
        return drawn(rng, FIGURES + LETTERS + CAPITALS, 20, 44), True
    if kind == 2:
        return drawn(rng, FIGURES + LETTERS + CAPITALS + "+/", 28, 60) + rng.choice(["", "=", "=="]), True
    if kind == 3:
        return drawn(rng, LETTERS, 2, 4) + rng.choice("_-") + drawn(rng, FIGURES + LETTERS + CAPITALS, 20, 40), True
    if kind == 4:
        return drawn(rng, CAPITALS + FIGURES, 14, 24), True
    if kind == 5:
        return drawn(rng, FIGURES + LETTERS + CAPITALS, 8, 16), False
    if kind == 6:
        return drawn(rng, LETTERS + CAPITALS, 10, 36), False
    if kind == 7:
        return "".join(w.capitalize() for w in rng.sample(words, min(len(words), rng.randint(2, 4)))) or "OpenSesame", False
    return (rng.choice(words) if words else "sesame").capitalize() + drawn(rng, FIGURES, 2, 5) + rng.choice("!$&%#") + drawn(rng, LETTERS, 0, 3), False


def harmless_value(rng: random.Random, words: list[str]) -> str:
    kind = rng.randrange(15)
    word = rng.choice([*words[:20], *PLAIN_NAMES])
    if kind == 0:
        return drawn(rng, FIGURES, 1, 10)
    if kind == 1:
        return f"{rng.randint(1, 31)}.{rng.randint(1, 12)}.{rng.randint(1900, 2099)}"
    if kind == 2:
        return f"{word.lower()}.{rng.randint(1, 99)}@{drawn(rng, LETTERS, 3, 8)}.example.com"
    if kind == 3:
        return f"https://www.{word.lower()}.example/{drawn(rng, LETTERS, 2, 9)}?id={rng.randint(1, 9999)}"
    if kind == 4:
        return f"v{rng.randint(0, 9)}.{rng.randint(0, 99)}.{rng.randint(0, 9)}"
    if kind == 5:
        return f"{word.lower()}_{drawn(rng, LETTERS, 2, 8)}.{rng.choice(['py', 'txt', 'html'])}"
    if kind == 6:
        return word.upper()
    if kind == 7:
        return f"+{rng.randint(1, 99)}-{drawn(rng, FIGURES, 3, 3)}-{drawn(rng, FIGURES, 4, 7)}"
    return word


def told_again(rng: random.Random, text: str) -> tuple[str, list[tuple[int, int]]]:
    """A window with something put into it: its text, and the spans of secrets."""
    words = [w for w in WORD.findall(text) if w.isalpha()]
    at = rng.choice([0, *(m.end() for m in WORD.finditer(text))])
    harmless = rng.random() < 0.4
    form = rng.choice(FORMS)
    if harmless:
        value = harmless_value(rng, words)
        name = rng.choice(PLAIN_NAMES) if rng.random() < 0.6 else rng.choice(HINTS)
        if rng.random() < 0.25:  # two words in one, without any cue
            value, form = rng.choice(("", "get")) + "".join(w.capitalize() for w in rng.sample([*words[:20], *PLAIN_NAMES], 2)), "{v}"
    else:
        value, shows = secret_value(rng, words)
        while form == "{v}" and not shows:
            form = rng.choice(FORMS)
        name = rng.choice(NAMES).format(k=rng.choice(HINTS))
        if form != "{v}" and shows and rng.random() < 0.3:
            name = rng.choice(PLAIN_NAMES)
    if rng.random() < 0.3:
        name = name.capitalize() if rng.random() < 0.6 else name.upper()
    put = form.format(k=name, K=name.upper(), v=value)
    lead = text[:at] + (" " if at else "")
    start = len(lead) + put.rindex(value)
    return lead + put + " " + text[at:].lstrip(), [] if harmless else [(start, start + len(value))]


def tags_of(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    tags, last = [], None
    for m in WORD.finditer(text):
        hit = next((s for s in spans if s[0] < m.end() and m.start() < s[1]), None)
        tags.append(OUTSIDE if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return np.array(tags, np.int64)


def values_of(text: str) -> list[tuple[int, int]]:
    """The values in the matches of the fixed patterns."""
    found = [m.span(g) for _, p, g, least in KINDS for m in p.finditer(text) if m.end(g) - m.start(g) >= least]
    return sorted(found)


def windows(text: str, words: int) -> list[str]:
    """The words around every match of a fixed pattern, and the window with the least hash."""
    places = [m.span() for m in WORD.finditer(text)]
    if not places:
        return []
    starts = np.array([a for a, _ in places])
    cuts = []
    for a, _ in values_of(text)[:8]:
        i = int(np.searchsorted(starts, a, "right")) - 1
        cuts.append(max(0, i - words // 2))
    cuts.append(int(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % max(1, len(places) - words))
    return [text[places[i][0] : places[min(i + words, len(places)) - 1][1]] for i in cuts]


def fit_tokens(docs: DataFrame, sample: int = SAMPLE, words: int = WINDOW) -> crf.Model:
    """Token model from windows of sampled documents, labelled by the fixed patterns and told again with other cues and values.

    The training sample is bounded: the documents with the least hashes of their ids, one
    row of each, and of each nine windows of as many words at most. Null ids are passed
    over. Without any word the model is empty, and finds nothing.
    """
    chosen = sorted({*sampled_ids(docs, "doc_id", sample)})
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL").where(F.col("doc_id").isin(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [windows(t, words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "found"])

    cut = rows.mapInArrow(run, "doc_id long, found array<string>") if chosen else None
    # Of rows that share an id one counts, whichever task it is in.
    found = cut.groupBy("doc_id").agg(F.min("found").alias("found")).collect() if chosen else []
    texts = [t for r in sorted(found, key=lambda r: r["doc_id"]) for t in r["found"]]
    rng = random.Random(len(texts))
    told = [(t, values_of(t)) for t in texts] + [told_again(rng, t) for t in texts for _ in range(3)]
    told = [(t, spans) for t, spans in told if t.strip(" \t\n\x0b\x0c\r")]
    if not told:
        return crf.empty(N_FEATURES, 3)
    types = Types()
    tokens = read([t for t, _ in told], types)
    x = tokens.rows(types.shapes(), slice(None))
    sequences = [x[a:b] for a, b in zip(tokens.starts, tokens.starts[1:], strict=False)]
    return crf.fit(sequences, [tags_of(t, spans) for t, spans in told], N_FEATURES, 3, epochs=50)


# -- scan ------------------------------------------------------------------------


@dataclass
class Tagger:
    """A model with the different tokens it has met, as many as TYPES at a time."""

    model: crf.Model

    def __post_init__(self) -> None:
        self.forget()
        m = self.model.moves
        through = m[:, :, None] + m[None, :, :]  # from, at, to
        first = float(np.ptp(self.model.first))
        gain = max(float((through[:, x] - through[:, OUTSIDE]).max()) for x in (BEGIN, INSIDE))
        at_start = max(float((m[x] - m[OUTSIDE]).max()) for x in (BEGIN, INSIDE)) + first
        at_end = max(float((m[:, x] - m[:, OUTSIDE]).max()) for x in (BEGIN, INSIDE))
        self.margin = max(gain, at_start, at_end, first, 0.0) + 1e-6

    def forget(self) -> None:
        self.types, self.own = Types(), np.zeros((0, 3))

    def scores(self, tokens: Tokens) -> np.ndarray:
        """Tokens x tags: what the weights of a token itself sum to, once per type, and those of its neighbourhood."""
        shapes, weights = self.types.shapes(), self.model.weights
        new = shapes[:N_SHAPE, len(self.own) :] + FIRST[:N_SHAPE, None]
        self.own = np.concatenate((self.own, sum(weights[row] for row in new)))
        out = self.own[tokens.types]
        for column in tokens.places:
            out += weights[column]
        return out

    def tags(self, texts: list[str]) -> list[np.ndarray]:
        """Best tags of the tokens of every text, as Viterbi gives them for its whole chain."""
        if len(self.types) > TYPES:
            self.forget()
        tokens = read(texts, self.types)
        score, starts = self.scores(tokens), tokens.starts
        # Outside is sure where no other tag can win, whatever the neighbours are.
        open_ = score[:, OUTSIDE] - score[:, 1:].max(axis=1) <= self.margin
        out = np.zeros(len(score), np.int64)
        places = np.flatnonzero(open_)
        if len(places):
            text_of = np.searchsorted(starts, places, "right")
            # Runs of open tokens with the sure ones beside them; runs that touch are one.
            new = np.r_[True, (np.diff(places) > 2) | (np.diff(text_of) != 0)]
            heads = np.flatnonzero(new)
            lasts = np.r_[heads[1:], len(places)] - 1
            a = np.maximum(places[heads] - 1, starts[text_of[heads] - 1])
            b = np.minimum(places[lasts] + 2, starts[text_of[heads]])
            # A run that begins with a sure token has it outside, whatever the scores of a start say.
            for i, j, tags in zip(a, b, crf.viterbi(self.model, [tokens.rows(self.types.shapes(), slice(i, j)) for i, j in zip(a, b, strict=True)]), strict=True):
                out[i:j] = tags
        return [out[i:j] for i, j in zip(starts, starts[1:], strict=False)]


def model_spans(text: str, model: crf.Model | Tagger, base: list[tuple[str, int, int]], tags: np.ndarray | None = None) -> list[tuple[str, int, int]]:
    """Spans that the model adds: tagged tokens without their wrapping and name, where no base span overlaps."""
    if tags is None:
        tags = (model if isinstance(model, Tagger) else Tagger(model)).tags([text])[0]
    if not tags.any():
        return []
    out: list[list[int]] = []
    for i, m in enumerate(WORD.finditer(text)):
        if tags[i] == INSIDE and out and i and tags[i - 1] != OUTSIDE:
            out[-1][1] = m.end()
        elif tags[i] != OUTSIDE:
            named = NAMED.match(m[0])
            out.append([m.start() + (named.start(2) if named and "://" not in m[0] else 0), m.end()])
    found, at = [], 0
    base = sorted(base, key=lambda s: s[1])
    reach = 0  # the furthest end of the base spans that begin before a span's end
    for a, b in out:
        while a < b and text[a] in WRAP:
            a += 1
        while a < b and text[b - 1] in WRAP:
            b -= 1
        while at < len(base) and base[at][1] < b:
            reach = max(reach, base[at][2])
            at += 1
        if a < b and reach <= a:
            found.append((MODEL_KIND, a, b))
    return found


def spelled(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, model: crf.Model, carry: bool = False) -> DataFrame:
    """Secrets of every row of docs(doc_id, text).

    doc_id, n_assign, n_access, n_hex (spans of the fixed patterns), base_sha256 (of
    those spans, spelled kind:start:end by start and kind, joined by commas), spans
    (all spans spelled so, the model's of kind 'model' after the others) and redacted
    (the text with each region of spans replaced by [secret]). Offsets are code
    points, ends exclusive; spans of one kind never overlap. A null or empty text has
    no spans and an empty redaction. Null ids are kept, repeated rows give repeated
    rows, other columns are left out; with carry they come along as row.
    """
    blank = not model.weights.any()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for whole in batches:
            for batch in chunks(whole, "text", 1 << 20):
                counts, base_hash, all_spans, redacted = [], [], [], []
                texts = [t or "" for t in batch.column("text").to_pylist()]
                tags = [None] * len(texts) if blank else tagger.tags(texts)
                for text, own in zip(texts, tags, strict=True):
                    base = base_spans(text)
                    more = [] if blank else model_spans(text, tagger, base, own)
                    spans = sorted([*base, *more], key=lambda s: (s[1], ORDER[s[0]], s[2]))
                    counts.append([sum(s[0] == k for s in base) for k, *_ in KINDS])
                    base_hash.append(hashlib.sha256(spelled(base).encode()).hexdigest())
                    all_spans.append(spelled(spans))
                    parts, end = [], 0
                    for _, a, b in spans:
                        if a >= end:
                            parts += [text[end:a], "[secret]"]
                        end = max(end, b)
                    redacted.append("".join([*parts, text[end:]]) if spans else text)
                columns = [pa.array(c, pa.int64()) for c in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * 3
                rest = [batch.column("row")] if carry else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *columns, *(pa.array(c, pa.string()) for c in (base_hash, all_spans, redacted)), *rest],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted", *(["row"] if carry else [])],
                )

    rows = narrow(docs, carry)
    return rows.mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"
        + row_schema(rows),
    )
