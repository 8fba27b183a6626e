"""Content by selector: the inner HTML of the first matching element.

A selector is read once per page. The elements that one of its compounds names
become candidates; combinators then meet over the candidates' intervals, one
window per step, so tokens are not copied for alternatives or steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.markup import raw_attribute
from pagemill.functions.reuse import reuse
from pagemill.functions.text import let, web_trim
from pagemill.operators.elements import PAGE_END, elements
from pagemill.operators.layout import deal_pages

MAX_STEPS = 6

_NAME = r"[A-Za-z_\-][A-Za-z0-9_\-]*"
_TEST = rf"\[\s*{_NAME}\s*(?:[~|^$*]?=\s*(?:\"[^\"\]]*\"|'[^'\]]*'|[A-Za-z0-9_\-]+)\s*)?\]"
_NTH = r":(?:nth-child\(\s*(?:odd|even|[+\-]?[0-9]{0,6}n(?:\s*[+\-]\s*[0-9]{1,6})?|[+\-]?[0-9]{1,6})\s*\)|first-child|last-child|only-child)"
_SIMPLE = rf"#{_NAME}|\.{_NAME}|{_TEST}|{_NTH}"
_BASIC = rf"(?:(?:\*|{_NAME})(?:{_SIMPLE})*|(?:{_SIMPLE})+)"
_NOT = rf":not\(\s*{_BASIC}\s*\)"
_COMPOUND = rf"(?:(?:\*|{_NAME})(?:{_SIMPLE}|{_NOT})*|(?:{_SIMPLE}|{_NOT})+)"
_JOIN = r"(?:\s*[>+~]\s*|\s+)"
_CHAIN = rf"{_COMPOUND}(?:{_JOIN}{_COMPOUND}){{0,{MAX_STEPS - 1}}}"
_SUPPORTED = rf"^{_CHAIN}(?:\s*,\s*{_CHAIN})*$"


def is_supported(selector: Column) -> Column:
    return F.coalesce(web_trim(selector).rlike(_SUPPORTED), F.lit(False))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _nth(text: Column) -> Column:
    """{a, b, last} of a position test: the a k + b-th child for some k from 0, counted from the end if last."""
    inner = F.regexp_replace(F.regexp_extract(text, r"\((.*)\)", 1), r"\s", "")
    step = F.regexp_extract(inner, "^([+-]?[0-9]*)n", 1)
    sign = F.when(step.isin("", "+"), "1").when(step == "-", "-1").otherwise(step)
    rest = F.regexp_extract(inner, r"([+-]?[0-9]+)$", 1)
    a = F.when(inner.isin("odd", "even"), 2).when(inner.contains("n"), sign.try_cast("int")).otherwise(0)
    b = F.when(inner == "odd", 1).when(inner == "even", 0).otherwise(F.coalesce(rest.try_cast("int"), F.lit(0)))
    named = text.endswith("-child")
    return F.struct(
        F.when(named, 0).otherwise(a).alias("a"), F.when(named, 1).otherwise(b).alias("b"), (text == ":last-child").alias("last")
    )


def _read(compound: Column) -> Column:
    """A compound without :not, taken apart."""
    tests = F.transform(
        _all(compound, _TEST),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, rf"^\[\s*({_NAME})", 1)).alias("name"),
            F.regexp_extract(t, rf"^\[\s*{_NAME}\s*([~|^$*]?=)", 1).alias("how"),
            F.regexp_replace(F.regexp_extract(t, r"(?s)=\s*(.*?)\s*\]$", 1), r"""^["']|["']$""", "").alias("value"),
        ),
    )
    bare = F.regexp_replace(compound, r"\[[^\]]*\]", "")
    only = F.array(F.lit(":first-child"), F.lit(":last-child"))
    places = F.flatten(F.transform(_all(bare, _NTH), lambda p: F.when(p == ":only-child", only).otherwise(F.array(p))))
    plain = F.regexp_replace(bare, _NTH, "")
    return F.struct(
        F.lower(F.regexp_extract(plain, rf"^({_NAME})", 1)).alias("tag"),
        _all(plain, rf"#({_NAME})", 1).alias("ids"),
        _all(plain, rf"\.({_NAME})", 1).alias("classes"),
        tests.alias("tests"),
        F.transform(places, _nth).alias("places"),
    )


def read_selector(selector: Column) -> Column:
    """Array of {alt, step, how, next, is, nots} over the compounds of a supported
    selector; `how` is the combinator before a compound and `next` the one after
    (a space for any depth). Empty for others."""

    def chain(text: Column, alt: Column) -> Column:
        compounds = _all(text, rf"(?:{_JOIN}|^)({_COMPOUND})", 1)
        joins = F.transform(
            _all(text, rf"({_JOIN}|^){_COMPOUND}", 1), lambda j: F.when(F.trim(j) == "", F.lit(" ")).otherwise(F.trim(j))
        )
        return let(
            joins,
            lambda hows: F.transform(
                compounds,
                lambda c, i: F.struct(
                    alt.alias("alt"),
                    i.alias("step"),
                    F.get(hows, i).alias("how"),
                    F.get(hows, i + 1).alias("next"),
                    _read(F.regexp_replace(c, _NOT, "")).alias("is"),
                    F.transform(_all(c, _NOT), lambda n: _read(F.regexp_extract(n, rf":not\(\s*({_BASIC})\s*\)", 1))).alias("nots"),
                ),
            ),
        )

    chains = F.transform(_all(web_trim(selector), _CHAIN), chain)
    return F.when(is_supported(selector), F.flatten(chains))


def _holds(test: Column) -> Column:
    """Does the element pass a test of an attribute?"""
    how, wanted = test["how"], test["value"]

    def compare(value: Column) -> Column:
        word = (wanted != "") & ~wanted.contains(" ")
        return (
            F.when(how == "", value.isNotNull())
            .when(how == "=", value == wanted)
            .when(how == "~=", word & F.array_contains(F.split(value, r"[ \t\r\n\f]+"), wanted))
            .when(how == "|=", (value == wanted) | value.startswith(F.concat(wanted, F.lit("-"))))
            .when(how == "^=", (wanted != "") & value.startswith(wanted))
            .when(how == "$=", (wanted != "") & value.endswith(wanted))
            .otherwise((wanted != "") & value.contains(wanted))
        )

    return F.coalesce(let(raw_attribute(F.col("raw"), test["name"]), compare), F.lit(False))


def _is(basic: Column) -> Column:
    """Does the element fit a compound that `_read` took apart?"""

    def placed(place: Column) -> Column:
        nth = F.when(place["last"], F.col("nth_last")).otherwise(F.col("nth"))
        ahead = nth - place["b"]
        return F.when(place["a"] == 0, ahead == 0).otherwise(
            (F.try_mod(ahead, place["a"]) == 0) & (F.signum(ahead) * F.signum(place["a"]) >= 0)
        )

    classes = F.split(F.coalesce(raw_attribute(F.col("raw"), "class"), F.lit("")), r"[ \t\r\n\f]+")
    return F.coalesce(
        ((basic["tag"] == "") | (F.col("tag") == basic["tag"]))
        & F.forall(basic["places"], placed)
        & ((F.size(basic["ids"]) == 0) | F.forall(basic["ids"], lambda i: raw_attribute(F.col("raw"), "id") == i))
        & ((F.size(basic["classes"]) == 0) | (F.size(F.array_except(basic["classes"], classes)) == 0))
        & F.forall(basic["tests"], _holds),
        F.lit(False),
    )


@reuse
def _steps() -> Column:
    return read_selector(F.col("selector"))


@reuse
def _fits() -> Column:
    """The steps of `steps` whose compound the element fits."""
    return F.filter("steps", lambda s: _is(s["is"]) & ~F.exists(s["nots"], _is))


def matching(elements: DataFrame, steps: DataFrame) -> DataFrame:
    """The `elements` that the selector of their page names, given
    `steps(page_id, steps)` from `read_selector`.

    Step after step, a candidate stays if one that stayed in the step before
    stands before it and, as the combinator says, reaches beyond it, is its
    parent, or shares its parent: a running maximum over the candidates of a
    page, alternative and key.
    """
    named = elements.join(steps.hint("shuffle_hash"), "page_id")
    rows = named.select("*", F.explode(_fits()).alias("s")).drop("steps")
    rows = rows.withColumn("stays", F.col("s.step") == 0)
    for k in range(MAX_STEPS - 1):
        begins, ends = F.col("s.step") == k, F.col("s.step") == k + 1
        how = F.when(begins, F.col("s.next")).when(ends, F.col("s.how"))
        key = (
            F.when(how == " ", F.lit(-2))
            .when(how == "~", F.col("parent"))
            .when(begins, F.col("at"))
            .otherwise(F.when(how == ">", F.col("parent")).otherwise(F.col("before")))
        )
        order = W.partitionBy("page_id", "s.alt", key).orderBy("at", F.desc("s.step")).rowsBetween(W.unboundedPreceding, -1)
        reach = F.when(begins & F.col("stays"), F.when(how == " ", F.col("post")).otherwise(F.lit(PAGE_END)))
        found = F.coalesce(F.max(reach).over(order) > F.col("at"), F.lit(False))
        rows = rows.withColumn("stays", F.when(ends, found).otherwise(F.col("stays")))
    last = F.col("stays") & F.col("s.next").isNull()
    return rows.filter(last).drop("stays", "s").dropDuplicates(["page_id", "at"])


def select_content(pages: DataFrame) -> DataFrame:
    """(page_id, selector, content, supported) for `pages(page_id, html, selector)`.

    Selectors hold compounds of tag or `*`, `#id`, `.class`, `[name]`,
    `[name=value]` (also ~= |= ^= $= *=), `:nth-child()`, `:first-child`,
    `:last-child`, `:only-child` and `:not()` of such a compound, up to
    MAX_STEPS of them joined by spaces, `>`, `+` or `~`, and alternatives parted
    by commas. Of the elements of all alternatives the first in the page counts.
    Content is '' where nothing matches, for a page without text and for an
    element that has no content; where the selector is of another kind,
    `supported` is false as well. Pages are moved once, by their key.
    """
    source = deal_pages(pages.select("page_id", "html"))
    asked = deal_pages(pages.select("page_id", "selector", is_supported(F.col("selector")).alias("supported")))
    steps = asked.filter("supported").select("page_id", _steps().alias("steps"))
    found = matching(elements(source), steps)
    first = found.groupBy("page_id").agg(F.min(F.struct("at", "size", "post", "kind")).alias("e"))
    chosen = asked.join(first, "page_id", "left")
    start = F.col("e.at") + F.col("e.size")
    inner = F.when(F.col("e.kind") == "open", F.substr("html", start + 1, F.greatest(F.col("e.post") - start, F.lit(0))))
    return source.join(chosen.hint("shuffle_hash"), "page_id").select(
        "page_id", "selector", F.coalesce(inner, F.lit("")).alias("content"), "supported"
    )
