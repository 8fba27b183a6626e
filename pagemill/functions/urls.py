"""URL splitting, checking, resolving and normalising, all as Column code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.addresses import canonical_ipv4, is_ip_literal
from pagemill.functions.idna import ascii_host
from pagemill.functions.text import let, web_trim

# Schemes whose URLs always carry a host, with default ports.
DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
# Schemes never fetched.
BLOCKED_SCHEMES = ("file", "data", "ftp", "gopher")
# Schemes a request may name.
REQUEST_SCHEMES = ("http", "https", "ftp")

_SPECIAL = r"^(?:https?|ftp):"
_SCHEME = r"^([a-z][a-z0-9+.\-]*):"

def clean_url(col: Column) -> Column:
    """Outer white space and inner tabs and line ends are not part of a URL; in
    web schemes a back slash before the query counts as a slash."""
    plain = F.regexp_replace(web_trim(col), r"[\t\r\n]", "")

    def fold(u: Column) -> Column:
        head = F.regexp_extract(u, r"^[^?#]*", 0)
        return F.when(
            F.contains(head, F.lit("\\")) & F.lower(head).rlike(_SPECIAL),
            F.concat(F.translate(head, "\\", "/"), F.substring(u, F.length(head) + 1, F.length(u))),
        ).otherwise(u)

    return let(plain, fold)


def _host(authority: Column) -> Column:
    raw = F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:\[\]]*)(?::[0-9]*)?$", 1))
    decoded = let(
        raw,
        lambda h: F.when(
            h.contains("%"), F.coalesce(F.lower(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B")))), h)
        ).otherwise(h),
    )
    bare = F.regexp_replace(decoded, r"^\[|\]$", "")
    return let(ascii_host(bare), lambda h: F.coalesce(canonical_ipv4(h), h))


def url_parts(col: Column) -> Column:
    """Struct of scheme, userinfo, host, port, path, query and fragment.

    The host is lower-cased, freed of brackets, international names take their
    ASCII form, and short, octal and hex IPv4 forms become dotted quads. Null when the text has no scheme.
    """

    def cut(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, "(?i)" + _SCHEME, 1))
        return let(F.named_struct(F.lit("u"), u, F.lit("scheme"), scheme), head)

    def head(v: Column) -> Column:
        u, scheme = v["u"], v["scheme"]
        web = scheme.isin(*DEFAULT_PORTS)
        prefix = F.when(web, F.regexp_extract(u, r"^[^:]*:/*[^/?#]*", 0)).otherwise(
            F.regexp_extract(u, r"^[^:]*:(?://[^/?#]*)?", 0)
        )
        cuts = F.named_struct(
            F.lit("authority"),
            F.regexp_replace(prefix, r"^[^:]*:/*", ""),
            F.lit("rest"),
            F.substring(u, F.length(prefix) + 1, F.length(u)),
        )
        return F.when(scheme != "", let(cuts, lambda c: fields(scheme, web, c["authority"], c["rest"])))

    def fields(scheme: Column, web: Column, authority: Column, rest: Column) -> Column:
        path = F.regexp_extract(rest, r"^[^?#]*", 0)
        return F.named_struct(
            F.lit("scheme"),
            scheme,
            F.lit("userinfo"),
            F.regexp_extract(authority, r"^(.*)@", 1),
            F.lit("host"),
            _host(authority),
            F.lit("port"),
            F.regexp_extract(authority, r":([0-9]+)$", 1),
            F.lit("path"),
            F.when(web & (path == ""), F.lit("/")).otherwise(path),
            F.lit("query"),
            F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1),
            F.lit("fragment"),
            F.regexp_extract(rest, r"^[^#]*(#.*)", 1),
        )

    return let(clean_url(col), cut)


def is_parsable(parts: Column) -> Column:
    """False where a URL parser would refuse the text."""
    host = parts["host"]
    numeric_tail = host.rlike(r"(?:^|\.)(?:[0-9]+|0x[0-9a-f]*)\.?$")
    bad_host = (
        (host == "")
        | host.rlike(r"[\x00-\x20#/<>?@\[\\\]^|%]")
        | (host.contains(":") & ~host.rlike(r"^[0-9a-f:.]+$"))
        | (numeric_tail & ~is_ip_literal(host))
    )
    port_ok = (parts["port"] == "") | (F.length(parts["port"]) <= 4) | (
        parts["port"].try_cast("bigint") <= 65535
    )
    web = parts["scheme"].isin(*DEFAULT_PORTS)
    return F.coalesce(parts["scheme"].isNotNull() & (~web | (~bad_host & port_ok)), F.lit(False))


def is_requestable(parts: Column) -> Column:
    """A web URL whose host is a dotted name with a letter TLD, or an address."""
    host = parts["host"]
    named = host.rlike(r"^[^.].*\.[a-z\x{A1}-\x{FFFF}][a-z0-9\-\x{A1}-\x{FFFF}]+$")
    return F.coalesce(
        is_parsable(parts)
        & parts["scheme"].isin(*REQUEST_SCHEMES)
        & ~host.rlike(r"[_ ]")
        & (named | is_ip_literal(host)),
        F.lit(False),
    )


def url_rule(url: Column, parts: Column) -> Column:
    """Name of the broken rule, `required` or `url`, or null."""
    blank = F.coalesce(web_trim(url), F.lit("")) == ""
    return F.when(blank, F.lit("required")).when(~is_requestable(parts), F.lit("url"))


def rule_message(rule: Column, field: str = "url") -> Column:
    return F.when(rule == "required", F.lit(f"The {field} field must be defined")).when(
        rule == "url", F.lit(f"The {field} field must be a valid URL")
    )


def url_issues(url: Column, field: str = "url") -> Column:
    """Array of {field, rule, message}; empty when the request URL is usable."""

    def issue(rule: Column) -> Column:
        one = F.struct(
            F.lit(field).alias("field"), rule.alias("rule"), rule_message(rule, field).alias("message")
        )
        return F.array_compact(F.array(F.when(rule.isNotNull(), one)))

    return let(let(url_parts(url), lambda p: url_rule(url, p)), issue)


def path_extension(parts: Column) -> Column:
    """Text from the last dot of the path on, lower-cased; null without a dot."""
    ext = F.lower(F.regexp_extract(_fold_dots(parts["path"]), r"\.[^.]*$", 0))
    return F.nullif(ext, F.lit(""))


def url_extension(url: Column) -> Column:
    return let(url_parts(url), path_extension)


def _fold_dots(path: Column) -> Column:
    """Remove `.` and `..` segments from an absolute path."""

    def fold(segments: Column) -> Column:
        kept = F.aggregate(
            segments,
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                s.rlike(r"(?i)^(?:\.|%2e){2}$"), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
            )
            .when(s.rlike(r"(?i)^(?:\.|%2e)$"), acc)
            .otherwise(F.concat(acc, F.array(s))),
        )
        ends_in_dots = F.element_at(segments, -1).rlike(r"(?i)^(?:\.|%2e){1,2}$")
        return let(
            kept,
            lambda k: F.concat(
                F.lit("/"),
                F.array_join(k, "/"),
                F.when(ends_in_dots & (F.size(k) > 0), F.lit("/")).otherwise(F.lit("")),
            ),
        )

    return let(
        path,
        lambda x: F.when(
            x.rlike(r"(?i)^/(?:.*/)?(?:\.|%2e)"), let(F.split(F.substring(x, 2, F.length(x)), "/"), fold)
        ).otherwise(x),
    )


def _encode(text: Column, safe: str) -> Column:
    """Percent-encode every run of characters outside the class `safe`."""

    def encode(x: Column) -> Column:
        runs = F.regexp_extract_all(x, F.lit(f"[{safe}]+|[^{safe}]+"), F.lit(0))
        encoded = F.transform(
            runs,
            lambda r: F.when(r.rlike(f"^[{safe}]"), r).otherwise(
                F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))
            ),
        )
        return F.when(x.rlike(f"[^{safe}]"), F.array_join(encoded, "")).otherwise(x)

    return let(text, encode)


# Printable ASCII that stays as written in a path, in a query and
# in a fragment.
_PATH_SAFE = r"!#-;=?-_a-z|~"
_QUERY_SAFE = r"!#-&(-;=?-~"
_FRAGMENT_SAFE = r"!#-;=?-_a-~"


def render_url(parts: Column) -> Column:
    """Normal text of a split URL: default port dropped, dots folded, encoded."""
    defaults = F.lit(None).cast("string")
    for scheme, port in DEFAULT_PORTS.items():
        defaults = F.when(parts["scheme"] == scheme, F.lit(port)).otherwise(defaults)
    web = parts["scheme"].isin(*DEFAULT_PORTS)
    host = F.when(parts["host"].contains(":"), F.concat(F.lit("["), parts["host"], F.lit("]"))).otherwise(
        parts["host"]
    )
    port = F.when(
        (parts["port"] == "") | F.coalesce(parts["port"] == defaults, F.lit(False)), F.lit("")
    ).otherwise(F.concat(F.lit(":"), parts["port"]))
    user = F.when(parts["userinfo"] == "", F.lit("")).otherwise(F.concat(parts["userinfo"], F.lit("@")))
    authority = F.when(
        web | (parts["host"] != "") | (parts["scheme"] == "file"), F.concat(F.lit("//"), user, host, port)
    ).otherwise(F.lit(""))
    path = F.when(web, _encode(_fold_dots(parts["path"]), _PATH_SAFE)).otherwise(parts["path"])
    return F.concat(
        parts["scheme"],
        F.lit(":"),
        authority,
        path,
        _encode(parts["query"], _QUERY_SAFE),
        _encode(parts["fragment"], _FRAGMENT_SAFE),
    )


def normalize_url(col: Column) -> Column:
    """Normal form of an absolute URL; null when it cannot be parsed."""
    return let(url_parts(col), lambda p: F.when(is_parsable(p), render_url(p)))


def resolve_text(base: Column, href: Column) -> Column:
    """Absolute text of `href` as seen from the split URL `base`; the result
    still has its dot segments."""
    origin = F.concat(
        base["scheme"],
        F.lit("://"),
        F.when(base["userinfo"] == "", F.lit("")).otherwise(F.concat(base["userinfo"], F.lit("@"))),
        F.when(base["host"].contains(":"), F.concat(F.lit("["), base["host"], F.lit("]"))).otherwise(base["host"]),
        F.when(base["port"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), base["port"])),
    )
    directory = F.regexp_extract(base["path"], r"^.*/", 0)

    def choose(h: Column) -> Column:
        return (
            F.when(h.rlike("(?i)" + _SCHEME), h)
            .when(h.startswith("//"), F.concat(base["scheme"], F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, h))
            .when(h.startswith("?"), F.concat(origin, base["path"], h))
            .when(h.startswith("#"), F.concat(origin, base["path"], base["query"], h))
            .when(h == "", F.concat(origin, base["path"], base["query"]))
            .otherwise(F.concat(origin, directory, h))
        )

    cleaned = F.regexp_replace(web_trim(href), r"[\t\r\n]", "")
    slashed = F.when(
        cleaned.contains("\\") & ~cleaned.rlike(r"(?i)" + _SCHEME),
        F.concat(
            F.translate(F.regexp_extract(cleaned, r"^[^?#]*", 0), "\\", "/"),
            F.regexp_extract(cleaned, r"[?#].*$", 0),
        ),
    ).otherwise(cleaned)
    return let(slashed, choose)


def resolve_href(base: Column, href: Column) -> Column:
    """Normalised absolute URL of `href` seen from the split URL `base`, or null."""
    return normalize_url(resolve_text(base, href))
