"""Which URLs may be fetched: protocols, private addresses, allow-lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.addresses import ip_to_int, is_ip_literal, is_private, parse_cidr
from pagemill.functions.reuse import reuse
from pagemill.functions.text import let
from pagemill.functions.urls import BLOCKED_SCHEMES, is_parsable, url_parts
from pagemill.operators.layout import mark_known, stored

INVALID = "Invalid URL"
PRIVATE = "URLs targeting private/internal IP addresses are not allowed"
# Hits of a look-up that every task may hold: some 20 MB of them.
MOST_BROADCAST = 500_000
REDIRECT = "Redirect target blocked by SSRF guard: "


def parse_cidrs(cidrs: DataFrame) -> DataFrame:
    """(cidr, bits, lo, hi) of the well-formed entries of `cidrs(cidr)`."""
    return cidrs.select("cidr", parse_cidr(F.col("cidr")).alias("r")).filter("r IS NOT NULL").select(
        "cidr", "r.bits", "r.lo", "r.hi"
    )


def _ranges(cidrs: tuple[str, ...]) -> list[tuple[int, int]]:
    """First and last address of the well-formed entries of a configuration list."""
    out = []
    for cidr in cidrs:
        m = re.fullmatch(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})/([0-9]{1,2})", cidr.strip(), re.ASCII)
        if m and int(m[2]) <= 32 and all(int(o) <= 255 for o in m[1].split(".")):
            size = 1 << 32 - int(m[2])
            low = sum(int(o) << s for o, s in zip(m[1].split("."), (24, 16, 8, 0), strict=True)) // size * size
            out.append((low, low + size - 1))
    return out


def _listed_range(address: Column, cidrs: tuple[str, ...]) -> Column:
    """Is the IPv4 address inside a range of a configuration list?"""
    ranges = _ranges(cidrs)
    if not ranges:
        return F.lit(False)

    def inside(value: Column) -> Column:
        hit = F.lit(False)
        for low, high in ranges:
            hit = hit | value.between(low, high)
        return hit

    return F.coalesce(let(ip_to_int(address), inside), F.lit(False))


def protocol_error(parts: Column) -> Column:
    return F.when(
        parts["scheme"].isin(*BLOCKED_SCHEMES),
        F.concat(F.lit("Protocol "), parts["scheme"], F.lit(": is not allowed")),
    )


def parts_error(p: Column, cidrs: tuple[str, ...] = (), hosts: tuple[str, ...] = ()) -> Column:
    """`guard_error` for a URL that is already split."""
    listed = p["host"].isin(*[h.lower() for h in hosts]) if hosts else F.lit(False)
    private = is_ip_literal(p["host"]) & is_private(p["host"]) & ~_listed_range(p["host"], cidrs)
    return (
        F.when(~is_parsable(p), F.lit(INVALID))
        .when(p["scheme"].isin(*BLOCKED_SCHEMES), protocol_error(p))
        .when(~listed & private, F.lit(PRIVATE))
    )


def guard_error(url: Column, cidrs: tuple[str, ...] = (), hosts: tuple[str, ...] = ()) -> Column:
    """Why the URL itself may not be fetched, or null. Names are not looked up.

    An allowed host skips the address tests, never the protocol test.
    """
    return let(url_parts(url), lambda p: parts_error(p, cidrs, hosts))


def redirect_error(error: Column, url: Column, final_url: Column) -> Column:
    """The guard's verdict on a final URL that differs from the requested one."""
    moved = final_url.isNotNull() & (final_url != url)
    return F.when(moved & error.isNotNull(), F.concat(F.lit(REDIRECT), final_url))


def resolved_error(error: Column, flag: Column) -> Column:
    """`error`, or the private-address message where a look-up found one."""
    return F.coalesce(error, F.when(F.coalesce(flag, F.lit(False)), F.lit(PRIVATE)))


def allowed_by_range(addresses: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Distinct `addr` among the private `addresses(addr)` that lie inside any
    IPv4 range of `cidrs(cidr)`, however long that list is.

    An equi-join per prefix: an address lies in a range of length b exactly
    where its first b bits equal those of the range. Only lengths that occur
    are looked up. Addresses are made distinct first; there are fewer than 52
    million private ones.
    """
    ranges = parse_cidrs(cidrs).select("bits", "lo").distinct()
    lengths = ranges.agg(F.collect_set("bits")).scalar()  # 33 at most
    keys = (
        addresses.select("addr")
        .distinct()
        .select("addr", ip_to_int(F.col("addr")).alias("value"))
        .filter("value IS NOT NULL")
        .select("addr", "value", F.explode(lengths).alias("bits"))
        .select(
            "addr",
            "bits",
            (F.col("value") - F.pmod(F.col("value"), F.pow(F.lit(2), 32 - F.col("bits")).cast("bigint"))).alias("lo"),
        )
    )
    return keys.join(ranges, ["bits", "lo"], "left_semi").select("addr").distinct()


def address_verdicts(addresses: DataFrame, cidrs: DataFrame) -> DataFrame:
    """Add `private` and `blocked` to `addresses(..., addr)`. A private address
    is let through inside an allowed IPv4 range; IPv6 never is."""
    tested = addresses.withColumn("private", is_private(F.col("addr")))
    marked = mark_known(tested, allowed_by_range(tested.filter("private"), cidrs), "addr", "in_range")
    return marked.withColumn("blocked", F.col("private") & ~F.col("in_range")).drop("in_range")


def _named_host(p: Column, hosts: tuple[str, ...]) -> Column:
    """Host of a fetchable URL when only a look-up can tell its address."""
    listed = p["host"].isin(*[h.lower() for h in hosts]) if hosts else F.lit(False)
    usable = is_parsable(p) & ~p["scheme"].isin(*BLOCKED_SCHEMES) & ~is_ip_literal(p["host"]) & ~listed
    return F.when(usable, p["host"])


@reuse
def _named_hosts(urls: tuple[str, ...], hosts: tuple[str, ...]) -> Column:
    """Array of {role, host}, one per URL column."""
    return F.transform(
        F.array(*[F.struct(F.lit(u).alias("role"), F.col(u).alias("url")) for u in urls]),
        lambda x: F.struct(
            x["role"].alias("role"), let(url_parts(x["url"]), lambda p: _named_host(p, hosts)).alias("host")
        ),
    )


@reuse
def _bad_address(cidrs: tuple[str, ...]) -> Column:
    return is_private(F.col("addr")) & ~_listed_range(F.col("addr"), cidrs)


def blocked_hosts(dns: DataFrame, cidrs: tuple[str, ...] = ()) -> DataFrame:
    """Distinct hosts of `dns(host, addr)` with an address that is private and
    not allowed. Only these few rows travel on."""
    return dns.filter(_bad_address(cidrs)).select(F.lower("host").alias("host")).distinct()


def lookup_flags(rows: DataFrame, dns: DataFrame, urls: tuple[str, ...], cidrs=(), hosts=()) -> DataFrame:
    """(page_id, `<url>_private`...) of the rows with a host name that resolves
    to a blocked address. Works on keys and host names only."""
    stacked = rows.select("page_id", F.explode(_named_hosts(urls, tuple(hosts))).alias("s")).select(
        "page_id", "s.role", "s.host"
    ).filter("host IS NOT NULL")
    hits = mark_known(stacked, blocked_hosts(dns, tuple(cidrs)), "host", "hit").filter("hit")
    return hits.groupBy("page_id").agg(*[F.max(F.col("role") == u).alias(f"{u}_private") for u in urls])


def with_lookups(
    rows: DataFrame, dns: DataFrame | None, urls: tuple[str, ...], cidrs=(), hosts=()
) -> DataFrame:
    """Add `<url>_private` for each column of `urls`: does its host name resolve
    to a blocked address?

    The look-up runs when this is called, over keys and host names, and its few
    hits are stored; rows stay where they are. Up to MOST_BROADCAST hits go to
    every task. More are hashed to the buckets of `rows`, if those are bucketed
    by `page_id` (`sources.pages.save_crawl`); only other rows would be shuffled.
    """
    if dns is None:
        return rows.select("*", *[F.lit(False).alias(f"{u}_private") for u in urls])
    flags = stored(lookup_flags(rows, dns, urls, cidrs, hosts), "lookups")
    few = flags.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(flags) if few else flags.hint("shuffle_hash"), "page_id", "left")


@reuse
def _verdict(url: str, cidrs: tuple[str, ...], hosts: tuple[str, ...]) -> Column:
    return resolved_error(guard_error(F.col(url), cidrs, hosts), F.col(f"{url}_private"))


def guard(
    rows: DataFrame,
    cidrs: tuple[str, ...] = (),
    hosts: tuple[str, ...] = (),
    dns: DataFrame | None = None,
    url: str = "url",
    final_url: str | None = "final_url",
) -> DataFrame:
    """Add `guard_error` and `redirect_error` to `rows(page_id, url, final_url)`."""
    urls = (url,) if final_url is None else (url, final_url)
    cidrs, hosts = tuple(cidrs), tuple(hosts)
    made = [_verdict(url, cidrs, hosts).alias("guard_error")]
    if final_url is not None:
        made.append(
            redirect_error(_verdict(final_url, cidrs, hosts), F.col(url), F.col(final_url)).alias("redirect_error")
        )
    return with_lookups(rows, dns, urls, cidrs, hosts).select("*", *made).drop(*[f"{u}_private" for u in urls])


def allow_hosts(rows: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Add `host_allowed` and `guard_error` with the allow-list as a table."""
    keyed = rows.withColumn("host", url_parts(F.col(url))["host"])
    marked = mark_known(keyed, hosts.select(F.lower("host").alias("host")), "host", "host_allowed")
    plain = guard_error(F.col(url))
    return marked.withColumn(
        "guard_error", F.when(F.col("host_allowed") & (plain == PRIVATE), F.lit(None)).otherwise(plain)
    )
