"""Internet address tests and arithmetic as Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import let, web_trim

# Private and local IPv4 ranges, first and last address.
PRIVATE_IPV4 = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
    ("0.0.0.0", "0.255.255.255"),
)
# Text prefixes of private and local IPv6 addresses. The mapped
# 172.16 to 172.31 range is tested apart.
PRIVATE_IPV6_PREFIXES = (
    "::1",
    "fc",
    "fd",
    "fe80:",
    "::ffff:127.",
    "::ffff:10.",
    "::ffff:192.168.",
    "::ffff:169.254.",
)
_MAPPED_172 = r"^::ffff:172\.(?:1[6-9]|2[0-9]|3[01])\."

_QUAD = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def _quad_value(text: str) -> int:
    value = 0
    for octet in text.split("."):
        value = value * 256 + int(octet)
    return value


def ip_to_int(addr: Column) -> Column:
    """Unsigned value of a dotted quad; null unless four parts in 0..255."""
    octets = F.transform(F.split(addr, r"\."), lambda p: p.try_cast("bigint"))

    def value(parts: Column) -> Column:
        total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)
        return F.when(F.forall(parts, lambda o: o <= 255), total)

    return F.when(addr.rlike(_QUAD), let(octets, value))


def int_to_ip(value: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftright(value, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)],
    )


def canonical_ipv4(host: Column) -> Column:
    """Dotted quad of an IPv4 host in short, octal or hex form; null otherwise.

    With fewer than four parts the last one fills the remaining bytes.
    """
    bare = F.regexp_replace(F.lower(host), r"\.$", "")
    parts = F.split(bare, r"\.")

    def number(p: Column) -> Column:
        """Value of a part; null when it is no number or larger than any address."""

        def based(digits: Column, base: int, most: int) -> Column:
            short = F.regexp_replace(digits, "^0+", "")
            return F.when(short == "", F.lit("0")).when(F.length(short) <= most, F.conv(short, base, 10))

        text = (
            F.when(p.rlike("^0x[0-9a-f]*$"), based(F.substring(p, F.lit(3), F.length(p)), 16, 8))
            .when(p.rlike("^0[0-7]+$"), based(p, 8, 11))
            .when(p.rlike("^(?:0|[1-9][0-9]*)$"), p)
        )
        return text.try_cast("bigint")

    def assemble(values: Column) -> Column:
        n = F.size(values)
        leading = F.slice(values, 1, n - 1)
        last = F.element_at(values, -1)
        room = F.element_at(
            F.array(*[F.lit(256 ** k).cast("bigint") for k in (4, 3, 2, 1)]), n
        )
        valid = F.forall(values, lambda v: v.isNotNull()) & F.forall(leading, lambda v: v <= 255) & (last < room)
        head = F.aggregate(leading, F.lit(0).cast("bigint"), lambda acc, v: acc * 256 + v)
        return F.when(F.coalesce(valid, F.lit(False)), int_to_ip(head * room + last))

    looks_numeric = bare.rlike(r"^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}$")
    return F.when(looks_numeric, let(F.transform(parts, number), assemble))


def is_ip_literal(host: Column) -> Column:
    """Dotted quad in range, or IPv6 text."""
    return F.coalesce(
        (host.contains(":") & host.rlike(r"^(?i)[0-9a-f:.]+$")) | ip_to_int(host).isNotNull(),
        F.lit(False),
    )


def _private_value(value: Column) -> Column:
    """Is the 32-bit value of an address in a private range?"""
    hit = F.lit(False)
    for low, high in PRIVATE_IPV4:
        hit = hit | value.between(_quad_value(low), _quad_value(high))
    return hit


def is_private_ipv4(addr: Column) -> Column:
    return F.coalesce(let(ip_to_int(addr), _private_value), F.lit(False))


def is_private_ipv6(addr: Column) -> Column:
    lowered = F.lower(addr)
    hit = lowered.rlike(_MAPPED_172)
    for prefix in PRIVATE_IPV6_PREFIXES:
        hit = hit | lowered.startswith(prefix)
    # An IPv4-mapped address in hex groups names the same host.
    mapped = F.regexp_extract(lowered, r"^::ffff:([0-9a-f]{1,4}:[0-9a-f]{1,4})$", 1)

    def from_groups(m: Column) -> Column:
        high = F.conv(F.substring_index(m, ":", 1), 16, 10).try_cast("bigint")
        low = F.conv(F.substring_index(m, ":", -1), 16, 10).try_cast("bigint")
        return (m != "") & let(high * 65536 + low, _private_value)

    return F.coalesce(addr.contains(":") & (hit | let(mapped, from_groups)), F.lit(False))


def is_private(addr: Column) -> Column:
    return is_private_ipv4(addr) | is_private_ipv6(addr)


def parse_cidr(cidr: Column) -> Column:
    """Struct of bits, lo and hi for an IPv4 range; null when malformed.

    The address must be a dotted quad in range and the length 0 to 32.
    """
    text = web_trim(cidr)
    address = ip_to_int(F.regexp_extract(text, r"^([0-9.]+)/[0-9]{1,2}$", 1))
    bits = F.regexp_extract(text, r"/([0-9]{1,2})$", 1).try_cast("int")

    def build(pair: Column) -> Column:
        size = F.pow(F.lit(2), 32 - pair["bits"]).cast("bigint")
        low = pair["address"] - F.pmod(pair["address"], size)
        return F.when(
            pair["address"].isNotNull() & pair["bits"].between(0, 32),
            F.struct(pair["bits"].alias("bits"), low.alias("lo"), (low + size - 1).alias("hi")),
        )

    return let(F.struct(address.alias("address"), bits.alias("bits")), build)
