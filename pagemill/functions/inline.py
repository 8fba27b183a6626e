"""From page tokens to marked text, and from marked text to inline Markdown.

Tags become single control characters, so that the rules below are plain string
work on one block of text. Page text is freed of these characters beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.markup import BLOCK_TAGS, OPAQUE_TAGS, TABLE_TAGS, raw_attribute, tag_of, tokens_of
from pagemill.functions.text import decode_entities, let, run_at_end, strip_controls
from pagemill.functions.urls import resolve_href

BREAK = "\x01"
CODE_OPEN, CODE_CLOSE, LANG_END = "\x02", "\x03", "\x17"
STRONG_OPEN, STRONG_CLOSE = "\x04", "\x05"
EM_OPEN, EM_CLOSE = "\x06", "\x07"
STRIKE_OPEN, STRIKE_CLOSE = "\x0e", "\x0f"
LINK_OPEN, LINK_TEXT, LINK_CLOSE = "\x10", "\x11", "\x12"
IMAGE_OPEN, IMAGE_CLOSE = "\x13", "\x14"
TASK_DONE, TASK_OPEN = "\x15", "\x16"
ROW, CELL, HEAD_CELL, TABLE_OPEN, TABLE_CLOSE = "\x19", "\x1a", "\x1b", "\x1c", "\x1d"
BLOCK, BODY = "\x1e", "\x1f"

# Scripts that are written without spaces between words.
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
# A letter of these counts as a word; otherwise words are runs between spaces.
WORD = rf"[{UNSPACED}]|[^ \t\r\n\f\x{{A0}}{UNSPACED}]+"

# Inline elements, the marks that open and close them, and the
# Markdown written on both sides.
_PAIRS = (
    (("strong", "b"), STRONG_OPEN, STRONG_CLOSE, "**"),
    (("em", "i"), EM_OPEN, EM_CLOSE, "_"),
    (("del", "s", "strike"), STRIKE_OPEN, STRIKE_CLOSE, "~~"),
)
_ESCAPED = r"([\\*_\[\]`])"


def escape_text(col: Column) -> Column:
    return F.regexp_replace(col, _ESCAPED, r"\\$1")


def unescape_text(col: Column) -> Column:
    return F.regexp_replace(col, r"\\([\\*_\[\]`])", "$1")


def _quoted(title: Column) -> Column:
    return let(
        F.coalesce(title, F.lit("")),
        lambda x: F.when(x == "", x).otherwise(
            F.concat(F.lit(' "'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
        ),
    )


def _values(raw: Column, tag: Column) -> Column:
    """Decoded target, title and detail of the inline tags that carry them."""
    target = F.when(tag == "a", raw_attribute(raw, "href")).when(tag == "img", raw_attribute(raw, "src"))
    detail = (
        F.when(tag == "img", raw_attribute(raw, "alt"))
        .when(tag == "code", raw_attribute(raw, "class"))
        .when(tag == "input", raw_attribute(raw, "type"))
    )
    title = F.when(tag.isin("a", "img"), raw_attribute(raw, "title"))
    return F.when(
        tag.isin("a", "img", "code", "input") & ~raw.startswith("</"),
        F.transform(
            F.array(target, title, detail),
            lambda v: strip_controls(decode_entities(v, in_attribute=True)),
        ),
    )


def _language(css_class: Column) -> Column:
    return F.regexp_extract(
        F.coalesce(css_class, F.lit("")), r"(?:^|[ \t\r\n\f])language-([^ \t\r\n\f]+)", 1
    )


def _piece(token: Column, base: Column | None) -> Column:
    raw, tag, values = token["raw"], token["tag"], token["values"]
    closing = raw.startswith("</")
    written, title, detail = values[0], values[1], F.coalesce(values[2], F.lit(""))

    def pair(open_mark: str, close_mark: str) -> Column:
        return F.when(closing, F.lit(close_mark)).otherwise(F.lit(open_mark))

    def reference(target: Column) -> Column:
        address = F.concat(target, _quoted(title))
        return (
            F.when((tag == "a") & target.isNotNull(), F.concat(F.lit(LINK_OPEN), address, F.lit(LINK_TEXT)))
            .when(
                (tag == "img") & (target != ""),
                F.concat(F.lit(IMAGE_OPEN + "!["), detail, F.lit("]("), address, F.lit(")" + IMAGE_CLOSE)),
            )
            .otherwise(F.lit(""))
        )

    # An empty image source stays empty; an empty link names the page itself.
    target = written
    if base is not None:
        target = F.when((tag == "a") | (written != ""), F.coalesce(resolve_href(base, written), written)).otherwise(
            written
        )
    task = F.when(
        F.lower(detail) == "checkbox",
        F.when(raw_attribute(raw, "checked").isNotNull(), F.lit(TASK_DONE)).otherwise(F.lit(TASK_OPEN)),
    ).otherwise(F.lit(""))

    is_text = ~raw.startswith("<") | (F.length(raw) == 1)
    piece = (
        F.when(is_text, escape_text(strip_controls(decode_entities(raw))))
        .when((tag == "") | tag.isin(*OPAQUE_TAGS), F.lit(""))
        .when(tag == "table", pair(TABLE_OPEN, TABLE_CLOSE))
        .when(tag.isin(*TABLE_TAGS) & closing, F.lit(""))
        .when(tag == "tr", F.lit(ROW))
        .when(tag == "td", F.lit(CELL))
        .when(tag == "th", F.lit(HEAD_CELL))
        .when(tag.isin(*TABLE_TAGS), F.lit(""))
        .when(tag.isin(*BLOCK_TAGS), F.concat(F.lit(BLOCK), raw, F.lit(BODY)))
        .when(tag == "br", F.lit(BREAK))
        .when((tag == "a") & closing, F.lit(LINK_CLOSE))
        .when(tag.isin("a", "img"), let(target, reference))
        .when((tag == "code") & closing, F.lit(CODE_CLOSE))
        .when(tag == "code", F.concat(F.lit(CODE_OPEN), _language(detail), F.lit(LANG_END)))
    )
    for tags, open_mark, close_mark, _ in _PAIRS:
        piece = piece.when(tag.isin(*tags), pair(open_mark, close_mark))
    return piece.when(tag == "input", task).otherwise(F.lit(""))


def marked_blocks(html: Column, base: Column | None = None) -> Column:
    """Array of blocks of a page, each `<opening tag> BODY <marked text>`.

    Inside `head` nothing counts until the next block tag. A table whose cells
    hold only inline content stays one block; other tables are cut at each cell.
    """
    tokens = F.transform(
        tokens_of(strip_controls(F.coalesce(html, F.lit("")))),
        lambda t: F.struct(t.alias("raw"), tag_of(t).alias("tag")),
    )
    tokens = F.transform(
        tokens, lambda t: F.struct(t["raw"], t["tag"], _values(t["raw"], t["tag"]).alias("values"))
    )
    stream = F.concat(F.lit(BODY), F.array_join(F.transform(tokens, lambda t: _piece(t, base)), ""))
    headless = let(
        stream,
        lambda s: F.when(
            s.contains(BLOCK + "<head") | s.contains(BLOCK + "<HEAD"),
            F.regexp_replace(
                s,
                r"(?i)\x1E<head(?:[ \t\r\n\f/][^\x1F]*)?>\x1F[^\x1C\x1E]*"
                r"(?:\x1E</?noscript[^\x1C\x1E]*)*",
                BLOCK + BODY,
            ),
        ).otherwise(s),
    )

    def tables(s: Column) -> Column:
        framed = F.regexp_replace(
            s,
            r"\x1C([^\x1C\x1D\x1E]*)\x1D",
            f"{BLOCK}<table>{BODY}$1{BLOCK}{BODY}",
        )
        chunks = F.transform(
            F.split(framed, BLOCK),
            lambda c: F.when(c.startswith(f"<table>{BODY}"), c).otherwise(
                F.regexp_replace(c, r"[\x19-\x1D]", BLOCK + BODY)
            ),
        )
        return F.when(s.rlike(r"[\x19-\x1D]"), F.array_join(chunks, BLOCK)).otherwise(s)

    return F.split(let(headless, tables), BLOCK)


def visible_text(body: Column) -> Column:
    """Words as a reader sees them: no link targets, no marks."""
    bare = F.regexp_replace(
        body, r"\x10[^\x11]*\x11|\x02[^\x17]*\x17|\x13[^\x14]*\x14|[\x02-\x08\x0B\x0E-\x18]", ""
    )
    return F.translate(bare, BREAK + ROW + CELL + HEAD_CELL, "    ")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def link_word_count(body: Column) -> Column:
    texts = F.regexp_extract_all(body, F.lit(r"\x10[^\x11]*\x11([^\x10\x12]*)"), F.lit(1))
    return F.when(
        body.contains(LINK_OPEN), word_count(visible_text(F.array_join(texts, " ")))
    ).otherwise(F.lit(0))


def has_content(body: Column) -> Column:
    return body.rlike(r"[^ \t\r\n\f\x{A0}\x01-\x14\x17-\x1F]")


def _span(opener: str, closer: str, mark: str):
    """A span runs from its opener to the next closer or the end of the block.
    Openers inside it and closers outside any span do nothing; a span without
    visible content vanishes; outer spaces move outside the marks."""

    def wrap(inner: Column) -> Column:
        lead = F.regexp_extract(inner, r"^[ \x01]*", 0)
        trail = F.regexp_extract(inner, run_at_end(r"[ \x01]"), 0)
        core = F.substring(inner, F.length(lead) + 1, F.length(inner) - F.length(lead) - F.length(trail))
        return F.when(inner.rlike(r"[^ \x01-\x1F]"), F.concat(lead, F.lit(mark), core, F.lit(mark), trail)).otherwise(
            inner
        )

    def one(segment: Column) -> Column:
        bare = F.translate(segment, opener + closer, "")
        return F.when(segment.startswith(opener), let(bare, wrap)).otherwise(bare)

    def rule(s: Column) -> Column:
        segments = F.regexp_extract_all(s, F.lit(f"{opener}[^{closer}]*{closer}?|[^{opener}]+"), F.lit(0))
        return F.when(
            s.contains(opener) | s.contains(closer), F.array_join(F.transform(segments, one), "")
        ).otherwise(s)

    return rule


def _code_spans(s: Column) -> Column:
    segments = F.regexp_extract_all(s, F.lit(r"\x02[^\x03]*\x03?|[^\x02]+"), F.lit(0))

    def one(segment: Column) -> Column:
        inner = F.regexp_replace(segment, r"\x10[^\x11]*\x11|\x02[^\x17]*\x17|[\x02-\x1F]", "")
        code = let(
            unescape_text(F.translate(inner, BREAK, " ")),
            lambda c: F.when(F.trim(c) == "", F.lit(""))
            .when(c.contains("`"), F.concat(F.lit("`` "), c, F.lit(" ``")))
            .otherwise(F.concat(F.lit("`"), c, F.lit("`"))),
        )
        return F.when(segment.startswith(CODE_OPEN), code).otherwise(F.translate(segment, CODE_CLOSE, ""))

    return F.when(
        s.contains(CODE_OPEN) | s.contains(CODE_CLOSE), F.array_join(F.transform(segments, one), "")
    ).otherwise(s)


def _line_starts(s: Column) -> Column:
    """Escape what would begin a block construct at the start of a line."""
    marks = F.regexp_replace(s, r"(^|\x01)( ?)(#{1,6} |>|-|\+ |=+|~~~)", r"$1$2\\$3")
    return F.regexp_replace(marks, r"(^|\x01)( ?[0-9]+)\. ", r"$1$2\\. ")


def inline_markdown(body: Column) -> Column:
    """Markdown of one block of marked text; a line break is still BREAK."""
    collapsed = F.regexp_replace(body, r"[ \t\r\n\f]+", " ")
    text = let(collapsed, _line_starts)
    text = let(text, _code_spans)
    for _, opener, closer, mark in _PAIRS:
        text = let(text, _span(opener, closer, mark))
    links = F.regexp_replace(text, r"\x10([^\x11]*)\x11([^\x10\x12]*)\x12?", "[$2]($1)")
    tasks = F.replace(
        F.replace(links, F.lit(TASK_DONE), F.lit("[x] ")), F.lit(TASK_OPEN), F.lit("[ ] ")
    )
    bare = F.regexp_replace(tasks, r"[\x02-\x1F]", "")
    spaced = F.regexp_replace(bare, " *\x01 *", BREAK)
    return F.regexp_replace(F.regexp_replace(spaced, " +", " "), rf"^[ \x01]++|{run_at_end(r'[ \x01]')}", "")


def inline_parts(body: Column, tag: Column, opened: Column) -> Column:
    """Inline Markdown of a block as an array of {mark, md}: one part, or one
    per row mark and cell of a table, or none for code."""
    parts = (
        F.when(opened & (tag == "table"), F.split(body, r"(?=[\x19-\x1B])"))
        .when(opened & (tag == "pre"), F.array().cast("array<string>"))
        .otherwise(F.array(body))
    )
    return F.transform(
        parts, lambda p: F.struct(F.substring(p, 1, 1).alias("mark"), inline_markdown(p).alias("md"))
    )


def paragraph(parts: Column) -> Column:
    return F.replace(F.element_at(parts, 1)["md"], F.lit(BREAK), F.lit("  \n"))


def heading(parts: Column, level: Column) -> Column:
    text = F.translate(F.element_at(parts, 1)["md"], BREAK, " ")
    return let(
        text,
        lambda t: F.when(t == "", t).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t)),
    )


def rule_line(parts: Column) -> Column:
    return let(
        paragraph(parts),
        lambda t: F.when(t == "", F.lit("* * *")).otherwise(F.concat(F.lit("* * *\n\n"), t)),
    )


def code_block(body: Column, head: Column) -> Column:
    language = F.coalesce(
        F.nullif(F.regexp_extract(body, r"\x02([^\x17]+)\x17", 1), F.lit("")),
        _language(raw_attribute(head, "class")),
    )
    bare = F.regexp_replace(body, r"\x10[^\x11]*\x11|\x02[^\x17]*\x17|[\x02-\x08\x0E-\x1F]", "")
    text = unescape_text(F.translate(bare, BREAK, "\n"))
    trimmed = F.regexp_replace(text, rf"^\r?\n|{run_at_end(r'[ \t\r\n]')}", "")
    return let(
        trimmed,
        lambda t: F.when(t == "", t).otherwise(
            F.concat(F.lit("```"), language, F.lit("\n"), t, F.lit("\n```"))
        ),
    )


def table(parts: Column) -> Column:
    """Pipe table; the first row is the header when it holds header cells,
    otherwise the header is empty. Text before the first row comes first."""

    def cell(part: Column) -> Column:
        text = F.replace(F.translate(part["md"], BREAK, " "), F.lit("|"), F.lit("\\|"))
        return (
            F.when(part["mark"].isin(CELL, HEAD_CELL), F.concat(part["mark"], text))
            .when(part["mark"] == ROW, F.lit(ROW))
            .otherwise(F.replace(part["md"], F.lit(BREAK), F.lit("  \n")))
        )

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def cells_of(row: Column) -> Column:
        return let(F.split(row, r"[\x1A\x1B]"), lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))))

    def render(rows: Column) -> Column:
        first = F.element_at(rows, 1)
        columns = F.size(cells_of(first))
        headed = first.contains(HEAD_CELL)
        lines = F.transform(rows, lambda r: line(cells_of(r)))
        blank = F.when(headed, F.array().cast("array<string>")).otherwise(
            F.array(line(F.array_repeat(F.lit(""), columns)))
        )
        rule = line(F.array_repeat(F.lit("---"), columns))
        return let(
            F.concat(blank, lines),
            lambda x: F.array_join(F.concat(F.slice(x, 1, 1), F.array(rule), F.slice(x, 2, F.size(x))), "\n"),
        )

    def build(pieces: Column) -> Column:
        lead = F.translate(F.element_at(pieces, 1), CELL + HEAD_CELL, "  ")
        rows = F.filter(
            F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda r: r.rlike(r"[\x1A\x1B]")
        )
        grid = let(rows, lambda r: F.when(F.size(r) > 0, render(r)).otherwise(F.lit("")))
        return F.array_join(F.filter(F.array(F.trim(lead), grid), lambda x: x != ""), "\n\n")

    return let(F.split(F.array_join(F.transform(parts, cell), ""), ROW), build)
