"""Main text of HTML pages: the maximum-scoring run of tokens.

A page is cut into tags and words. Words score positive and tags negative, by weights
learnt from labelled pages; one linear scan (Kadane's) finds the contiguous run with the
greatest sum, which is the content region. Elements that are never part of a text by their
name, role or class (menus, footers, adverts, forms, comments) are taken out first.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import chunks, sampled_ids
from pagemill.llm.labelled_pages import CLOSE, LABELLED_PAGES, OPEN

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|textarea|title)(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<svg(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+(?:(?<=/)>|>.*?(?:</svg\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text><?[^<]+|<)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")

# Elements by what they do to a text.
DROPPED = frozenset("head nav footer aside form button select dialog menu input datalist canvas audio video".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 "
    "header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
) | DROPPED
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark an element as no part of the text.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar aside "
    "menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar header notice notices notification "
    "cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login signin search "
    "share sharing social related recommended recommendations widget toolbar pagination pager copyright legal disclaimer "
    "comment comments replies respond disqus discussion form paywall teaser teasers trending popular skip".split()
)
READERS = frozenset("comment comments replies respond disqus discussion".split())
#: Words that make a compound with a mark, as in cookie-notice-box; any other word takes the mark away.
BESIDE = frozenset(
    "box bar bars list lists section sections container wrapper wrap block blocks link links area widget site page top bottom left right "
    "primary secondary global inner outer item items button buttons content text body title meta icon icons panel thread slot unit main post posts "
    "user users reader readers policy message messages article articles story stories news latest more load count rail strip sticky fixed floating "
    "inline mobile desktop x".split()
)
#: Marks that a section of a text may well be named after.
TITLES = frozenset("discussion legal search social related notice notices recommendations copyright disclaimer popular trending form".split())
JUDGED_BY_NAME = frozenset("html body main article p h1 h2 h3 h4 h5 h6".split())
SPLIT_MARK = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
CONTENT = ("article", "main")
LEADS = frozenset("p h1 h2 h3 h4 h5 h6".split())
FRAMES = frozenset("div section article main td".split())
SAMPLE = 400
NAMES = (
    [("p", "p"), ("br", "inline"), ("a", "a"), ("li", "list"), ("ul", "list"), ("ol", "list"), ("img", "media")]
    + [(f"h{i}", "heading") for i in range(1, 7)]
    + [(n, "inline") for n in "b i em strong span u s code sup sub small mark abbr q cite time font tt kbd".split()]
    + [(n, "table") for n in "table tr td th tbody thead tfoot".split()]
    + [(n, "frame") for n in "div section article main body html".split()]
    + [(n, "quote") for n in "blockquote pre figure figcaption dl dt dd".split()]
)
GROUP = dict(NAMES)


@dataclass
class Token:
    kind: str  # word run, open, close, mark
    name: str
    text: str = ""
    attrs: str = ""
    partner: int = -1  # of an open tag: the place of its end
    gone: bool = False
    within: bool = False  # inside the page's article or main
    linked: bool = False
    words: int = field(default=0)


def tokens_of(page: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(page):
        if m["text"] is not None:
            text = m["text"]
            out.append(Token("text", "", text, words=len(text.split())))
        elif m["name"] is not None:
            if not m[0].endswith(">"):
                continue  # left open up to the end of the page: no element
            out.append(Token("close" if m["close"] else "open", m["name"].lower(), attrs=m["attrs"]))
        elif m["comment"] is not None and m[0] in (OPEN, CLOSE):
            out.append(Token("mark", m[0]))
        # Other comments, raw elements and declarations leave no token.
    return out


def pair(tokens: list[Token]) -> None:
    """Gives every open tag the place of its end: its closing tag, or the end of the element around it."""
    stack: list[int] = []
    count: Counter = Counter()
    for i, t in enumerate(tokens):
        if t.kind == "open" and t.name not in VOID and not t.attrs.endswith("/"):
            stack.append(i)
            count[t.name] += 1
        elif t.kind == "close" and count[t.name]:
            while stack:
                j = stack.pop()
                count[tokens[j].name] -= 1
                tokens[j].partner = i
                if tokens[j].name == t.name:
                    break
    for j in stack:
        tokens[j].partner = len(tokens)


def unwanted(token: Token, within: bool) -> str:
    """Why an element is no part of the text: 'name', 'mark', 'readers', or '' if it may be."""
    if token.name in DROPPED or token.name == "header" and not within:
        return "name"
    if not token.attrs or token.name in ("html", "body", "main"):
        return ""
    attrs = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token.attrs)}
    if attrs.get("role", "").lower() in ROLES or "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return "name"
    if token.name in JUDGED_BY_NAME:
        return ""
    words: set[str] = set()
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        own = {w.lower() for w in SPLIT_MARK.split(name) if w}
        if within and token.name in ("section", "div") and len(own) == 1 and own <= TITLES:
            continue  # a section may be named so
        if own & MARKS and own <= MARKS | BESIDE:
            words |= own & MARKS
    if within:
        words -= {"header"}
    return "readers" if words & READERS else "mark" if words else ""


def prepare(page: str) -> list[Token]:
    """Tokens of a page, with ends, unwanted elements marked gone, and the article or main known."""
    tokens = tokens_of(page)
    pair(tokens)
    before = np.cumsum([0, *(t.words for t in tokens)])
    holds = np.cumsum([0, *(t.kind == "open" and t.name in CONTENT for t in tokens)])
    names = {t.name for t in tokens if t.kind == "open"}
    aim = "article" if "article" in names else "main" if "main" in names else ""
    gone_until = within_until = linked_until = -1
    for i, t in enumerate(tokens):
        if t.kind == "open" and t.partner > 0 and i >= gone_until:
            # An element that was left open by mistake ends at the next block.
            end = t.partner
            closed = end < len(tokens) and tokens[end].name == t.name
            if t.name == aim and not unwanted(t, False):
                within_until = max(within_until, end)
            why = unwanted(t, i < within_until and t.name not in CONTENT)
            if why == "mark":
                # A class may speak of what stands beside: it takes out no article, and of a page
                # that names none not the element that holds most of it.
                stop = min(end, len(tokens))
                if holds[stop] - holds[i + 1] or not aim and 2 * (before[stop] - before[i]) > before[-1]:
                    why = ""
            if why:
                if not closed and t.name not in ("footer", "nav", "head"):
                    end = next((k for k in range(i + 1, end) if tokens[k].name in BLOCKS), end)
                gone_until = end + closed
            if t.name == "a":
                linked_until = max(linked_until, end if closed else i)
        t.gone = i < gone_until
        t.within = i < within_until
        t.linked = i < linked_until
    return tokens


def classes(tokens: list[Token]) -> list[str]:
    """Weight class of each token: where it stands, and what it is."""
    has = any(t.within for t in tokens)
    sizes, run = [0] * len(tokens), []
    total = 0
    for i, t in enumerate(tokens):  # words of the block around each text
        if t.kind in ("open", "close") and t.name in BLOCKS:
            for j in run:
                sizes[j] = total
            run, total = [], 0
        elif t.kind == "text":
            run.append(i)
            total += t.words
    for j in run:
        sizes[j] = total
    out = []
    for t, size in zip(tokens, sizes, strict=True):
        if has:  # the page says itself what its text is
            place = "in" if t.within else "beside"
            out.append(f"{place} word" if t.kind == "text" else f"{place} tag")
        elif t.kind == "text":
            length = "short" if size < 5 else "middle" if size < 15 else "long"
            out.append(f"{'linked' if t.linked else 'plain'} word {length}")
        else:
            out.append(f"plain tag {GROUP.get(t.name, 'other')}")
    return out


def count_classes(tokens: list[Token], inside: list[bool]) -> Counter:
    """(class, inside) to its tokens; words count each."""
    out: Counter = Counter()
    for t, kind, content in zip(tokens, classes(tokens), inside, strict=True):
        if t.kind != "mark" and not t.gone:
            out[kind, content] += t.words if t.kind == "text" else 1
    return out


def labelled_counts() -> Counter:
    out: Counter = Counter()
    for page in LABELLED_PAGES:
        tokens = prepare(page)
        inside, now = [], False
        for t in tokens:
            now = (t.name == OPEN) if t.kind == "mark" else now
            inside.append(now)
        out += count_classes(tokens, inside)
    return out


def weights_from(counts: Counter) -> dict[str, float]:
    """Log-odds of each class inside and outside content: words at least 0.1, tags at most -0.1.

    Pages with an article or main and pages without are two populations.
    """
    out = {}
    for own in ({"in", "beside"}, {"plain", "linked"}):
        kinds = {k for k, _ in counts if k.split()[0] in own}
        inside = sum(counts[k, True] for k in kinds)
        outside = sum(counts[k, False] for k in kinds)
        for kind in kinds:
            odds = np.log((counts[kind, True] + 1) / (inside + len(kinds)))
            odds -= np.log((counts[kind, False] + 1) / (outside + len(kinds)))
            out[kind] = float(max(0.1, odds) if " word" in kind else min(-0.1, odds))
    return out


def fit_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from the labelled pages of this package and from a bounded sample of pages.

    The sample is the pages with the least hashes of their ids; of it, those with an
    article or main element are labelled by that element. Null ids are passed over.
    """
    chosen = sampled_ids(pages, "page_id", sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for page in batch.column("html").to_pylist():
                tokens = prepare(page or "")
                if any(t.within for t in tokens):
                    counts += count_classes(tokens, [t.within for t in tokens])
            kinds, inside = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(inside, pa.bool_()), pa.array(list(counts.values()), pa.int64())],
                names=["kind", "inside", "n"],
            )

    counts = labelled_counts()
    if chosen:
        rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).where(F.col("page_id").isin(chosen))
        rows = rows.select("html").mapInArrow(run, "kind string, inside boolean, n long")
        for r in rows.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect():
            counts[r["kind"], r["inside"]] += r["n"]
    return weights_from(counts)


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the run with the greatest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


def edge(token: Token) -> bool:
    """Whether a block starts or ends here."""
    return token.kind in ("open", "close") and token.name in BLOCKS


def widened(tokens: list[Token], start: int, end: int) -> tuple[int, int]:
    """A run in whole blocks, and on over blocks beside it.

    Short blocks at the edges of the content cost more in tags than their words bring. A
    run within the page's article or main is all of that element. Elsewhere blocks belong
    to it where the same element holds them, short of the page itself, and links are no
    more than half of them; before the run, headings and paragraphs may be links.
    """
    if start >= end:
        return start, end
    def whole(i: int, step: int) -> int:
        """From a place to the end of its block in one direction."""
        while 0 <= i < len(tokens) and not edge(tokens[i]):
            i += step
        return i

    def belongs(own: list[Token], lead: bool) -> bool:
        shown = [t for t in own if t.kind == "text" and t.words and not t.gone]
        linked = sum(t.words for t in shown if t.linked)
        return 2 * linked <= sum(t.words for t in shown) or lead and any(t.kind == "open" and t.name in LEADS for t in own)

    start, end = whole(start - 1, -1) + 1, whole(end, 1)
    around = [(i, t.partner) for i, t in enumerate(tokens[:start]) if t.kind == "open" and t.partner >= end and t.name not in ("html", "body")]
    within = [(i, j) for i, j in around if tokens[i].name in CONTENT and tokens[i].within]
    if within:
        return within[0][0] + 1, min(within[0][1], len(tokens))
    if around and around[-1] == (start - 1, end) and tokens[start - 1].name not in FRAMES:
        around.pop()  # the one block of the run itself
    low, high = around[-1] if around else (start, end)
    if not around:
        low = next((i for i, t in enumerate(tokens[:start]) if t.kind == "open" and t.name == "body"), start)
    while end < high:
        stop = whole(end + 1, 1)
        if not belongs(tokens[end:stop], False):
            break
        end = stop
    while start > low + 1:
        first = whole(start - 2, -1) + 1
        # A block begins with the tag before its words.
        if not belongs(tokens[max(low + 1, first - 1) : start], True):
            break
        start = first
    return start, min(end, len(tokens))


def main_text(page: str, weights: dict[str, float]) -> str:
    """Blocks of the content region, in page order, joined by two line feeds."""
    tokens = prepare(page)
    scores = []
    for t, kind in zip(tokens, classes(tokens), strict=True):
        weight = weights.get(kind, 0.1 if t.kind == "text" else -1.0)
        scores.append(0.0 if t.gone or t.kind == "mark" else weight * t.words if t.kind == "text" else weight)
    start, end = widened(tokens, *best_run(scores))
    blocks, parts = [], []
    for t in tokens[start:end]:
        if t.kind == "text":
            if not t.gone:
                parts.append(t.text)
        elif t.name in BLOCKS:
            blocks.append("".join(parts))
            parts = []
        elif t.name == "br":
            parts.append(" ")
    blocks.append("".join(parts))
    clean = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Main text of every row of pages(page_id, url, html): page_id, url, text, n_chars.

    n_chars counts code points. A null or empty page, and one without a word of content, has the
    empty text. White space of any kind within a block becomes one space. Null ids and
    URLs are kept, repeated rows give repeated rows, other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "html"):
                texts = [main_text(p or "", weights) for p in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
