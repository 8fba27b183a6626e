"""Text helpers: trimming, flag words, comma lists, character references."""

from __future__ import annotations

from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space a web `trim` removes (tab to carriage return,
# space, no-break space, the Unicode space separators, line and paragraph
# separators, byte order mark).
TRIM_CLASS = (
    r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# HTML white space.
HTML_SPACE = r"[ \t\r\n\f]"

# Control characters carry structure inside the page job, so page text is freed
# of them first. Tab, line feed, form feed and carriage return stay.
CONTROL_CLASS = r"[\x01-\x08\x0B\x0E-\x1F]"

# The words that mean "true" in a request flag.
TRUE_WORDS = ("true", "1")


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times inside one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def run_at_end(one: str) -> str:
    """Pattern of the run of `one` at the end; tried from the start of a run only, so runs elsewhere cost their length."""
    return rf"(?<!{one}){one}++\z"


def web_trim(col: Column) -> Column:
    return F.regexp_replace(col, rf"^{TRIM_CLASS}++|{run_at_end(TRIM_CLASS)}", "")


def strip_controls(col: Column) -> Column:
    return F.regexp_replace(col, CONTROL_CLASS, "")


def flag_word(col: Column) -> Column:
    return F.coalesce(web_trim(col).isin(*TRUE_WORDS), F.lit(False))


def comma_list(col: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), web_trim)
    return F.filter(parts, lambda p: p != "")


# The references met most often, answered without a search.
FREQUENT = {"amp;": "&", "nbsp;": "\u00a0", "quot;": '"', "lt;": "<", "gt;": ">", "apos;": "'", "copy;": "\u00a9"}


@lru_cache(maxsize=None)
def _reference_tables() -> tuple[str, ...]:
    """Named references as lines `name=text`, one table per first letter from A to z.
    Few string literals keep the plan small, and a search reads one short table."""
    tables = {chr(c): ["\n"] for c in range(ord("A"), ord("z") + 1)}
    for name, text in html5.items():
        if "\n" not in text:
            tables[name[0]].append(f"{name}={text}\n")
    return tuple("".join(lines) for lines in tables.values())


def _named(name: Column) -> Column:
    """Text of a named reference (letters and digits, perhaps with a semicolon), null when unknown."""

    def search(v: Column) -> Column:
        return F.when(
            v["table"].contains(v["key"]),
            F.substring_index(F.call_function("substring_index", v["table"], v["key"], F.lit(-1)), "\n", 1),
        )

    tables = F.array(*[F.lit(t) for t in _reference_tables()])
    both = F.named_struct(
        F.lit("table"),
        F.try_element_at(tables, F.ascii(name) - (ord("A") - 1)),
        F.lit("key"),
        F.concat(F.lit("\n"), name, F.lit("=")),
    )
    found = F.when(name.rlike("^[A-Za-z]"), let(both, search))
    frequent = None
    for key, text in FREQUENT.items():
        frequent = F.when(name == key, F.lit(text)) if frequent is None else frequent.when(name == key, F.lit(text))
    return frequent.when(name == "NewLine;", F.lit("\n")).otherwise(found)


@lru_cache(maxsize=None)
def _old_names() -> str:
    """Pattern of the names that may stand without a semicolon, longer ones first."""
    return "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


# Numeric references 128 to 159 mean the Windows-1252 characters: one character
# per number, the number's own where that code page has none.
_REMAPPED = "".join(
    bytes([n]).decode("cp1252", errors="ignore") or chr(n) for n in range(0x80, 0xA0)
)


def _code_point(number: Column) -> Column:
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(~F.coalesce(valid, F.lit(False)), F.lit("\ufffd"))
        .when(number.between(0x80, 0x9F), F.substring(F.lit(_REMAPPED), (number - 0x7F).cast("int"), F.lit(1)))
        .otherwise(char)
    )


def decode_entities(col: Column, in_attribute: bool = False) -> Column:
    """Character references to characters; unknown names stay as written.

    Text also accepts the old names that may stand without a semicolon, before
    anything; attribute values accept them only where no letter, digit or equals
    sign follows, so that `?a=1&copy=2` keeps its query. Numbers of any length
    are read; those beyond Unicode give the replacement character.
    """
    bare = f"(?:{_old_names()})" + (r"(?![a-zA-Z0-9=])" if in_attribute else "")
    reference = rf"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*;|{bare})"

    def numeric(piece: Column) -> Column:
        # Leading zeros apart, no character needs more than 6 hex or 7 decimal digits.
        digits = F.regexp_extract(piece, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
        number = F.when(piece.rlike("^&#[xX]"), F.when(F.length(digits) <= 6, F.conv(digits, 16, 10))).otherwise(
            F.when(F.length(digits) <= 7, digits)
        )
        return let(number.try_cast("bigint"), _code_point)

    def old(piece: Column) -> Column:
        """The longest old name that an unknown name starts with, then the rest as written."""
        name = F.regexp_extract(piece, f"^&({_old_names()})", 1)
        return F.when(name != "", F.concat(_named(name), F.substring(piece, F.length(name) + 2, F.length(piece))))

    def one(piece: Column) -> Column:
        known = _named(F.substring(piece, F.lit(2), F.length(piece)))
        return (
            F.when(~piece.startswith("&"), piece)
            .when(piece.rlike("^&#[xX]?[0-9a-fA-F]"), numeric(piece))
            .otherwise(F.coalesce(known, piece if in_attribute else old(piece), piece))
        )

    def whole(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(rf"{reference}|&|[^&]+"), F.lit(0))
        return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)

    return let(col, whole)
