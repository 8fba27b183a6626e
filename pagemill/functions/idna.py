"""International host names in the ASCII form that name servers know.

A label outside ASCII is written by the Bootstring algorithm with the parameters of
Punycode. The code points to insert are put in order at once; what is left is a fold
over them that carries the state of a decoder and adapts its bias.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let

# Punycode's parameters and digits.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# Full stops that part labels, and characters that a name does not keep.
STOPS = "\u3002\uff0e\uff61"
DROPPED = "\u00ad\u180b\u180c\u180d\u200b\u200c\u200d\u2060\ufeff" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: A longer label would not fit the 63 places of a name; it stays as written.
LONGEST = 59
NOT_ASCII = r"[^\x00-\x7F]"


@lru_cache
def lookalikes() -> tuple[str, str]:
    """Characters whose compatibility form is one ASCII letter, digit, hyphen or full stop, and those."""
    plain = "abcdefghijklmnopqrstuvwxyz0123456789-."
    found = {chr(c): unicodedata.normalize("NFKC", chr(c)).lower() for c in range(128, 0x20000) if not 0xD800 <= c < 0xE000}
    found = {c: to for c, to in found.items() if len(to) == 1 and to in plain} | dict.fromkeys(STOPS, ".")
    return "".join(found), "".join(found.values())


def _record(**fields: Column) -> Column:
    """A struct whose names stand as literals: aliases inside a lambda are lost beside a generator."""
    return F.named_struct(*(part for name, value in fields.items() for part in (F.lit(name), value)))


def _div(a: Column, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _adapted(delta: Column, length: Column, first: Column) -> Column:
    """The bias after an insertion into a text of the given length, itself included."""
    damped = let(F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2)), lambda d: d + _div(d, length))
    start = _record(d=damped, k=F.lit(0).cast("long"))
    limit, step = (BASE - T_MIN) * T_MAX // 2, BASE - T_MIN
    # 35 ** 5 is beyond any delta of a label of LONGEST code points.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(5)),
        start,
        lambda s, _: F.when(s["d"] > limit, _record(d=_div(s["d"], step), k=s["k"] + BASE)).otherwise(s),
        lambda s: s["k"] + _div((step + 1) * s["d"], s["d"] + SKEW),
    )


def _digits(delta: Column, bias: Column) -> Column:
    """delta as digits of mixed radix, the least first."""

    def digit(value: Column) -> Column:
        return F.substring(F.lit(DIGITS), (value + 1).cast("int"), 1)

    def step(s: Column, j: Column) -> Column:
        def emit(t: Column) -> Column:
            more = s["q"] - t
            return F.when(s["q"] < t, state(F.lit(-1), F.concat(s["out"], digit(s["q"])))).otherwise(
                state(_div(more, BASE - t), F.concat(s["out"], digit(t + more % (BASE - t))))
            )

        threshold = F.least(F.greatest(BASE * j - bias, F.lit(T_MIN)), F.lit(T_MAX))
        return F.when(s["q"] < 0, s).otherwise(let(threshold, emit))

    def state(q: Column, out: Column) -> Column:
        return _record(q=q.cast("long"), out=out)

    # Each digit divides by at least 10, and a delta has at most 8 decimal places.
    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), state(delta, F.lit("")), step, lambda s: s["out"])


def bootstring(label: Column) -> Column:
    """Punycode of a label, without a prefix."""

    def write(codes: Column) -> Column:
        # A code point is inserted after the lesser ones and the equal ones before it.
        added = F.transform(
            codes,
            lambda c, at: F.when(
                c >= FIRST_CODE,
                _record(c=c, at=at, place=F.size(F.filter(F.slice(codes, 1, at), lambda x: x <= c))),
            ),
        )
        basic = F.regexp_replace(label, NOT_ASCII, "")

        def state(code, place, bias, length, out) -> Column:
            numbers = {"code": code, "place": place, "bias": bias, "length": length}
            return _record(**{n: v.cast("long") for n, v in numbers.items()}, out=out)

        def insert(s: Column, x: Column) -> Column:
            def done(delta: Column) -> Column:
                length = s["length"] + 1
                bias = _adapted(delta, length, s["length"] == F.length(basic))
                return state(x["c"], x["place"] + 1, bias, length, F.concat(s["out"], _digits(delta, s["bias"])))

            return let((x["c"] - s["code"]) * (s["length"] + 1) + x["place"] - s["place"], done)

        start = state(
            F.lit(FIRST_CODE), F.lit(0), F.lit(FIRST_BIAS), F.length(basic),
            F.when(basic == "", basic).otherwise(F.concat(basic, F.lit("-"))),
        )
        return F.aggregate(F.array_sort(F.array_compact(added)), start, insert, lambda s: s["out"])

    return let(F.transform(F.split(label, ""), F.ascii), write)


def ascii_host(host: Column) -> Column:
    """A lower-cased host with every label in ASCII.

    Compatibility forms of ASCII characters (wide, circled, mathematical ones) become those,
    other full stops a full stop, and invisible characters go; so no address can be
    written past the guard in them. Labels of more than LONGEST code points are no names
    and stay as written. A letter and a mark that follows it are not composed.
    """
    wide, plain = lookalikes()

    def named(label: Column) -> Column:
        long = F.length(label) > LONGEST
        return F.when(long | ~label.rlike(NOT_ASCII), label).otherwise(F.concat(F.lit("xn--"), bootstring(label)))

    def joined(h: Column) -> Column:
        return F.when(h.rlike(NOT_ASCII), F.array_join(F.transform(F.split(h, r"\."), named), ".")).otherwise(h)

    return F.when(host.rlike(NOT_ASCII), let(F.translate(host, wide + DROPPED, plain), joined)).otherwise(host)
