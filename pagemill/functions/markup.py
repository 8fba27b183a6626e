"""Cutting stored HTML into tokens and reading tags, as Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import HTML_SPACE, decode_entities

# Quoted attribute values may hold any character; a quote that has no partner is
# a character like others. A tag that is left open reaches to the end of the
# page, as in a browser, and is no element. So every `<` that begins a tag ends
# one, no character is looked at from two of them, and the time to cut a page
# grows with its length. Possessive loops keep the match free of recursion.
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_END = r"(?:>|\z)"

_OPAQUE = (
    r"<!--.*?(?:-->|\z)"
    r"|<script(?:[ \t\r\n\f/][^>]*+)?>.*?(?:</script[ \t\r\n\f]*+>|\z)"
    r"|<style(?:[ \t\r\n\f/][^>]*+)?>.*?(?:</style[ \t\r\n\f]*+>|\z)"
    r"|<title(?:[ \t\r\n\f/][^>]*+)?>.*?(?:</title[ \t\r\n\f]*+>|\z)"
)
_MARKUP = rf"{_OPAQUE}|</?[a-z]{_ATTRS}{_END}|<[!?/][^>]*+{_END}"

# Joined in order, the matches give back the whole text.
TOKEN_REGEX = rf"(?is){_MARKUP}|[^<]+|<"

# One match per anchor (open tag and everything up to the next anchor tag), and
# one per token that could hide something looking like an anchor. Hidden parts
# and other tags are passed over whole, inside anchors as outside.
ANCHOR_TAG = rf"<a(?:[ \t\r\n\f/]{_ATTRS})?>"
ANCHOR_REGEX = (
    rf"(?is){_OPAQUE}"
    rf"|{ANCHOR_TAG}(?:[^<]++|{_OPAQUE}|</?(?!a[ \t\r\n\f/>])[a-z]{_ATTRS}{_END}|<(?!/?a[ \t\r\n\f/>]))*+"
    rf"|</?[a-z]{_ATTRS}{_END}"
)

# Elements without content.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
)

# Elements that start and end a block of text. Table parts are
# included; a table whose cells hold only inline content is one block.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "dd",
    "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
    "noscript", "ol", "optgroup", "option", "p", "pre", "search", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
    "ul",
)
TABLE_TAGS = ("table", "thead", "tbody", "tfoot", "tr", "td", "th")
OPAQUE_TAGS = ("script", "style", "title")


def tokens_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN_REGEX), F.lit(0))


def tag_of(raw: Column) -> Column:
    """Name of a tag; empty for other tokens and for a tag that is left open."""
    return F.when(raw.endswith(">"), F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][^ \t\r\n\f/>]*)", 1))).otherwise(F.lit(""))


def kind_of(raw: Column, tag: Column) -> Column:
    """open, close, void, text, or drop for what never shows."""
    return (
        F.when(~raw.startswith("<") | (F.length(raw) == 1), F.lit("text"))
        .when((tag == "") | tag.isin(*OPAQUE_TAGS), F.lit("drop"))
        .when(raw.startswith("</"), F.lit("close"))
        .when(tag.isin(*VOID_TAGS), F.lit("void"))
        .otherwise(F.lit("open"))
    )


def _attribute_pattern(name: str) -> str:
    s = HTML_SPACE
    not_s = r"[^ \t\r\n\f/>=]"
    value = r"""(?:"[^"]*+"|'[^']*+'|[^ \t\r\n\f>]*+)"""
    skip = rf"(?:[ \t\r\n\f/]++(?!{name}[ \t\r\n\f/>=]){not_s}++(?:{s}*+={s}*+{value})?+)*+"
    return (
        rf"(?is)^<[a-z][^ \t\r\n\f/>]*+{skip}[ \t\r\n\f/]++{name}(?=[ \t\r\n\f/>=])"
        rf"(?:{s}*+={s}*+({value}))?+"
    )


def raw_attribute(raw: Column, name: str | Column) -> Column:
    """Value of the first attribute `name` as written; null when absent, empty
    when it has no value. Text inside other attributes' values never matches.
    A name that differs by row holds letters, digits, `-` and `_` only."""
    if isinstance(name, Column):
        pieces = _attribute_pattern("\0").split("\0")
        pattern = F.concat(F.lit(pieces[0]), *[x for p in pieces[1:] for x in (name, F.lit(p))])
    else:
        pattern = F.lit(_attribute_pattern(name))
    text = F.call_function("regexp_extract", raw, pattern, F.lit(1))
    bare = F.regexp_replace(text, r"""(?s)^(?:"(.*)"|'(.*)')$""", "$1$2")
    return F.when(F.call_function("rlike", raw, pattern), bare)


def attribute(raw: Column, name: str) -> Column:
    """Decoded value of the first attribute `name`; null when absent."""
    return decode_entities(raw_attribute(raw, name), in_attribute=True)


def plain_text(markup: Column) -> Column:
    """Text of a piece of HTML: tags and hidden parts gone, references decoded."""
    return decode_entities(F.regexp_replace(markup, rf"(?is){_MARKUP}", ""))


def page_title(html: Column) -> Column:
    """Trimmed text of the first title element; null when empty or missing."""
    from pagemill.functions.text import web_trim

    pattern = (
        r"(?is)^(?:[^<]|<!--.*?-->|<(?!!--|title[ \t\r\n\f/>]|script[ \t\r\n\f/>]|style[ \t\r\n\f/>])"
        r"|<script(?:[ \t\r\n\f/][^>]*)?>.*?</script[ \t\r\n\f]*>"
        r"|<style(?:[ \t\r\n\f/][^>]*)?>.*?</style[ \t\r\n\f]*>)*+"
        r"<title(?:[ \t\r\n\f/][^>]*)?>(.*?)(?:</title[ \t\r\n\f]*>|\z)"
    )
    inner = F.regexp_extract(html, pattern, 1)
    return F.nullif(web_trim(decode_entities(inner)), F.lit(""))
