"""SQL for another engine that states what each query must return.

Written from the definitions, mostly by another route than the Spark code:
tokens as rows with window functions instead of arrays inside the scan, paths
folded as strings instead of lists, simple joins instead of salted ones.
"""

from __future__ import annotations

from pagemill.functions.idna import DROPPED, LONGEST, lookalikes
from pagemill.plans.fixtures import DOCX, duck_fixture
from pagemill.plans.queries import BODY_CAP, INTAKE_CAP, MD_RULES, REQUESTS

ORACLES: dict[str, str] = {}

_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_PRIVATE = "URLs targeting private/internal IP addresses are not allowed"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


# -- addresses ---------------------------------------------------------------


def octet(c: str, i: int) -> str:
    return f"TRY_CAST(split_part({c}, '.', {i}) AS BIGINT)"


def ip_int(c: str) -> str:
    parts = [octet(c, i) for i in range(1, 5)]
    ok = " AND ".join(f"{p} <= 255" for p in parts)
    return (
        f"CASE WHEN regexp_full_match({c}, '[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}') AND {ok} THEN "
        f"{parts[0]} * 16777216 + {parts[1]} * 65536 + {parts[2]} * 256 + {parts[3]} END"
    )


def private_v4(c: str) -> str:
    a, b = octet(c, 1), octet(c, 2)
    return (
        f"coalesce(({ip_int(c)}) IS NOT NULL AND ({a} IN (0, 10, 127) OR ({a} = 172 AND {b} BETWEEN 16 AND 31) "
        f"OR ({a} = 192 AND {b} = 168) OR ({a} = 169 AND {b} = 254)), false)"
    )


def private_v6(c: str) -> str:
    return (
        f"coalesce(contains({c}, ':') AND regexp_matches(lower({c}), '^(::1|fc|fd|fe80:|::ffff:(127\\.|10\\.|192\\.168\\.|"
        f"169\\.254\\.|172\\.(1[6-9]|2[0-9]|3[01])\\.))'), false)"
    )


def literal(c: str) -> str:
    return (
        f"coalesce((contains({c}, ':') AND regexp_full_match(lower({c}), '[0-9a-f:.]+')) OR ({ip_int(c)}) IS NOT NULL, false)"
    )


def private(c: str) -> str:
    return f"({private_v4(c)} OR {private_v6(c)})"


def quad_of(c: str) -> str:
    """Dotted quad of a short, octal or hex IPv4 host."""
    parts = f"string_split(regexp_replace({c}, '\\.$', ''), '.')"
    number = (
        "CASE WHEN p = '0x' THEN 0 "
        "WHEN regexp_full_match(p, '0x0*[0-9a-f]{0,15}') THEN list_reduce([instr('0123456789abcdef', h) - 1 FOR h IN string_split(right(substr(p, 3), 15), '')], lambda a, b: a * 16 + b) "
        "WHEN regexp_full_match(p, '0+[0-7]{1,20}') THEN list_reduce([CAST(h AS BIGINT) FOR h IN string_split(right(p, 20), '')], lambda a, b: a * 8 + b) "
        "WHEN regexp_full_match(p, '0|[1-9][0-9]{0,17}') THEN TRY_CAST(p AS BIGINT) END"
    )
    return f"""(SELECT CASE WHEN NOT list_contains([x IS NULL FOR x IN n], true)
        AND len(n) <= 4 AND len([x FOR x IN n[1:len(n)-1] IF x > 255]) = 0
        AND n[len(n)] < CAST(pow(256, 5 - len(n)) AS BIGINT) THEN
      (SELECT CAST(v // 16777216 AS VARCHAR) || '.' || CAST(v // 65536 % 256 AS VARCHAR) || '.' ||
              CAST(v // 256 % 256 AS VARCHAR) || '.' || CAST(v % 256 AS VARCHAR)
       FROM (SELECT CASE len(n) WHEN 1 THEN n[1] WHEN 2 THEN n[1] * 16777216 + n[2]
         WHEN 3 THEN n[1] * 16777216 + n[2] * 65536 + n[3] ELSE n[1] * 16777216 + n[2] * 65536 + n[3] * 256 + n[4] END AS v)) END
     FROM (SELECT CASE WHEN regexp_full_match({c}, '(0x[0-9a-f]*|[0-9]+)(\\.(0x[0-9a-f]*|[0-9]+)){{0,3}}\\.?')
       THEN [CAST(({number}) AS BIGINT) FOR p IN {parts}] END AS n))"""


# -- URLs --------------------------------------------------------------------


def url_ctes(source: str, key: str, col: str, p: str = "u") -> str:
    """CTEs that split `col` of `source`; the last one is `{p}` with columns
    key, scheme, userinfo, host, port, path, query, fragment, ok."""
    host_bad = (
        "host = '' OR regexp_matches(host, '[\\x00-\\x20#/<>?@\\[\\\\\\]^|%]') "
        "OR (contains(host, ':') AND NOT regexp_full_match(host, '[0-9a-f:.]+')) "
        f"OR (regexp_matches(host, '(^|\\.)([0-9]+|0x[0-9a-f]*)\\.?$') AND NOT {literal('host')})"
    )
    return f"""
{p}0 AS (SELECT {key} AS k, regexp_replace({trim(col)}, '[\\t\\r\\n]', '', 'g') AS c FROM {source}),
{p}1 AS (SELECT *, lower(regexp_extract(c, '^([a-zA-Z][a-zA-Z0-9+.\\-]*):', 1)) AS scheme FROM {p}0),
{p}2 AS (SELECT *, scheme IN ('http', 'https', 'ftp') AS web, substr(c, length(scheme) + 2) AS rest FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN web THEN regexp_extract(rest, '^/*([^/?#]*)', 1)
      WHEN starts_with(rest, '//') THEN regexp_extract(rest, '^//([^/?#]*)', 1) ELSE '' END AS authority,
    CASE WHEN web THEN regexp_replace(rest, '^/*[^/?#]*', '')
      WHEN starts_with(rest, '//') THEN regexp_replace(rest, '^//[^/?#]*', '') ELSE rest END AS tail FROM {p}2),
{p}4 AS (SELECT *, CASE WHEN contains(authority, '@') THEN regexp_extract(authority, '^(.*)@', 1) ELSE '' END AS userinfo,
    regexp_extract(authority, ':([0-9]+)$', 1) AS port,
    regexp_replace(regexp_replace(lower(regexp_replace(authority, '^.*@', '')), ':[0-9]*$', ''), '^\\[|\\]$', '', 'g') AS h0,
    split_part(split_part(tail, '#', 1), '?', 1) AS p0 FROM {p}3),
{p}5 AS (SELECT *, CASE WHEN contains(lower(authority), '[') THEN regexp_extract(lower(authority), '\\[([^\\]]*)\\]', 1) ELSE h0 END AS h1 FROM {p}4),
{p}6 AS (SELECT *, coalesce({quad_of('h1')}, h1) AS host, CASE WHEN p0 = '' AND web THEN '/' ELSE p0 END AS path,
    CASE WHEN contains(split_part(tail, '#', 1), '?') THEN substr(split_part(tail, '#', 1), length(p0) + 1) ELSE '' END AS query,
    CASE WHEN contains(tail, '#') THEN substr(tail, instr(tail, '#')) ELSE '' END AS fragment FROM {p}5),
{p} AS (SELECT *, scheme <> '' AND c IS NOT NULL AS split_ok, coalesce(scheme <> '' AND (NOT web OR (NOT ({host_bad}) AND
    (port = '' OR length(port) <= 4 OR TRY_CAST(port AS BIGINT) <= 65535))), false) AS ok FROM {p}6)"""


def folded(path: str) -> str:
    """Path without dot segments, built up as text."""
    return (
        f"CASE WHEN starts_with({path}, '/') AND regexp_matches({path}, '/\\.') THEN "
        f"(SELECT CASE WHEN d AND NOT ends_with(f, '/') AND f <> '' THEN f || '/' WHEN f = '' THEN '/' ELSE f END FROM (SELECT "
        f"regexp_matches({path}, '/\\.\\.?$') AS d, "
        f"list_reduce(list_prepend('', string_split(substr({path}, 2), '/')), lambda acc, s: CASE WHEN s = '..' THEN "
        f"regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END) AS f)) ELSE {path} END"
    )


def encoded(text: str, safe: str) -> str:
    return (
        f"array_to_string([CASE WHEN regexp_matches(r, '^[{safe}]') THEN r ELSE url_encode(r) END "
        f"FOR r IN regexp_extract_all({text}, '[{safe}]+|[^{safe}]+')], '')"
    )


_PATH_SAFE = "!#-;=?-_a-z|~"
_QUERY_SAFE = "!#-&(-;=?-~"
_FRAGMENT_SAFE = "!#-;=?-_a-~"


def rendered(p: str = "") -> str:
    """Normal text of a row of `url_ctes`; `p` is a table prefix."""
    c = {n: f"{p}{n}" for n in ("scheme", "userinfo", "host", "port", "path", "query", "fragment", "web")}
    return (
        f"{c['scheme']} || ':' || CASE WHEN {c['web']} OR {c['host']} <> '' OR {c['scheme']} = 'file' THEN '//' || "
        f"CASE WHEN {c['userinfo']} <> '' THEN {c['userinfo']} || '@' ELSE '' END || "
        f"CASE WHEN contains({c['host']}, ':') THEN '[' || {c['host']} || ']' ELSE {c['host']} END || "
        f"CASE WHEN {c['port']} = '' OR ({c['scheme']} = 'http' AND {c['port']} = '80') OR ({c['scheme']} = 'https' AND {c['port']} = '443') "
        f"OR ({c['scheme']} = 'ftp' AND {c['port']} = '21') THEN '' ELSE ':' || {c['port']} END ELSE '' END || "
        f"CASE WHEN {c['web']} THEN {encoded('(' + folded(c['path']) + ')', _PATH_SAFE)} ELSE {c['path']} END || "
        f"{encoded(c['query'], _QUERY_SAFE)} || {encoded(c['fragment'], _FRAGMENT_SAFE)}"
    )


def resolved(h: str, b: str) -> str:
    """Absolute text of cleaned href `h` seen from URL row `b`."""
    origin = (
        f"{b}.scheme || '://' || CASE WHEN {b}.userinfo <> '' THEN {b}.userinfo || '@' ELSE '' END || {b}.host || "
        f"CASE WHEN {b}.port = '' THEN '' ELSE ':' || {b}.port END"
    )
    return f"""CASE WHEN regexp_matches({h}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {h}
    WHEN starts_with({h}, '//') THEN {b}.scheme || ':' || {h}
    WHEN starts_with({h}, '/') THEN {origin} || {h}
    WHEN starts_with({h}, '?') THEN {origin} || {b}.path || {h}
    WHEN starts_with({h}, '#') THEN {origin} || {b}.path || {b}.query || {h}
    WHEN {h} = '' THEN {origin} || {b}.path || {b}.query
    ELSE {origin} || regexp_extract({b}.path, '^.*/') || {h} END"""


URL_X = f"src AS ({duck_fixture('url_x')}), " + url_ctes("src", "id", "url")
HREF_X = (
    f"src AS ({duck_fixture('href_x')}), "
    + url_ctes("src", "id", "base", "b")
    + f", abs AS (SELECT s.id, s.href, b.host AS base_host, {resolved(trim('s.href'), 'b')} AS url FROM src s JOIN b ON b.k = s.id), "
    + url_ctes("abs", "id", "url", "t")
)
_WANTED = f"NOT regexp_matches(lower({trim('href')}), '^(#|javascript:|data:|vbscript:|mailto:)') AND {trim('href')} <> ''"

_ISSUE = (
    f"CASE WHEN coalesce({trim('s.url')}, '') = '' THEN 'required' WHEN NOT (u.ok AND u.web AND NOT regexp_matches(u.host, '[_ ]') AND "
    f"(regexp_full_match(u.host, '[^.].*\\.[a-z\\x{{A1}}-\\x{{FFFF}}][a-z0-9\\-\\x{{A1}}-\\x{{FFFF}}]+') OR {literal('u.host')})) THEN 'url' END"
)
_PROTOCOL = "CASE WHEN u.scheme IN ('file', 'data', 'ftp', 'gopher') THEN 'Protocol ' || u.scheme || ': is not allowed' END"

ORACLES["scan_pages"] = (
    "SELECT page_id, url, url AS final_url, 200 AS status, 'text/html' AS content_type, length(html) AS html_length FROM pages"
)
ORACLES["validate_url"] = f"""WITH {URL_X}, r AS (SELECT s.id, {_ISSUE} AS rule FROM src s JOIN u ON u.k = s.id)
SELECT id, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS n_issues, CASE WHEN rule IS NOT NULL THEN 'url' END AS field, rule,
  CASE rule WHEN 'required' THEN 'The url field must be defined' WHEN 'url' THEN 'The url field must be a valid URL' END AS message FROM r"""
ORACLES["guard_protocol"] = f"WITH {URL_X} SELECT k AS id, {_PROTOCOL} AS error FROM u"
ORACLES["guard_invalid"] = f"WITH {URL_X} SELECT k AS id, CASE WHEN NOT ok THEN 'Invalid URL' END AS error FROM u"
for _name, _expr, _as in (
    ("private_ipv4", private_v4("addr"), "private"),
    ("private_ipv6", private_v6("addr"), "private"),
    ("is_ip_literal", literal("addr"), "literal"),
    ("ip_to_int", ip_int("addr"), "value"),
):
    ORACLES[_name] = f"SELECT id, addr, {_expr} AS {_as} FROM ({duck_fixture('addr_x')}) a"
ORACLES["ip_canonical"] = f"""WITH h AS (SELECT id, split_part(split_part(url, '/', 3), ':', 1) AS host FROM ({duck_fixture('url_x')}) x)
SELECT id, host, {quad_of('lower(host)')} AS quad FROM h"""
ORACLES["url_parts"] = f"""WITH {URL_X} SELECT k AS id, CASE WHEN split_ok THEN scheme END AS scheme, CASE WHEN split_ok THEN userinfo END AS userinfo,
  CASE WHEN split_ok THEN host END AS host, CASE WHEN split_ok THEN port END AS port, CASE WHEN split_ok THEN path END AS path,
  CASE WHEN split_ok THEN query END AS query, CASE WHEN split_ok THEN fragment END AS fragment FROM u"""
ORACLES["normalize_url"] = f"WITH {URL_X} SELECT k AS id, CASE WHEN ok THEN {rendered()} END AS url FROM u"
_WIDE, _PLAIN = lookalikes()
_DIGIT = "substr('abcdefghijklmnopqrstuvwxyz0123456789', CAST({} AS BIGINT) + 1, 1)"
# The digits of each number are written one row at a time, the insertions in the order of their rank.
ORACLES["ascii_host"] = f"""WITH RECURSIVE src AS (SELECT id, translate(lower(host), '{_WIDE + DROPPED}', '{_PLAIN}') AS host,
    NOT regexp_full_match(host, '[\\x00-\\x7F]*') AS wide FROM ({duck_fixture('host_x')}) x),
parts AS (SELECT id, wide, unnest(string_split(host, '.')) AS l, generate_subscripts(string_split(host, '.'), 1) AS n FROM src),
labels AS (SELECT DISTINCT l FROM parts WHERE wide AND length(l) <= {LONGEST} AND NOT regexp_full_match(l, '[\\x00-\\x7F]*')),
codes AS (SELECT l, i, unicode(substr(l, i, 1)) AS c FROM (SELECT l, unnest(range(1, length(l) + 1)) AS i FROM labels)),
added AS (SELECT l, c, (SELECT count(*) FROM codes o WHERE o.l = codes.l AND o.i < codes.i AND o.c <= codes.c) AS place,
    row_number() OVER (PARTITION BY l ORDER BY c, i) AS k FROM codes WHERE c > 127),
walk AS (
  SELECT l, 0::BIGINT AS k, 128::BIGINT AS n, 0::BIGINT AS at, 72::BIGINT AS bias, length(b)::BIGINT AS h, NULL::BIGINT AS q, 0::BIGINT AS j,
    0::BIGINT AS delta, CASE WHEN b = '' THEN '' ELSE b || '-' END AS o
  FROM (SELECT l, regexp_replace(l, '[^\\x00-\\x7F]', '', 'g') AS b FROM labels)
  UNION ALL
  SELECT l, nk, nn, nat, CASE WHEN q < t THEN k36 + 36 * dd // (dd + 38) ELSE bias END, CASE WHEN q < t THEN h + 1 ELSE h END,
    CASE WHEN q IS NULL THEN fresh WHEN q >= t THEN (q - t) // (36 - t) END, CASE WHEN q IS NULL THEN 1 ELSE j + 1 END,
    CASE WHEN q IS NULL THEN fresh ELSE delta END,
    CASE WHEN q IS NULL THEN o WHEN q < t THEN o || {_DIGIT.format('q')} ELSE o || {_DIGIT.format('(t + (q - t) % (36 - t))')} END
  FROM (SELECT *, CASE WHEN d <= 455 THEN 0 WHEN d // 35 <= 455 THEN 36 WHEN d // 1225 <= 455 THEN 72 WHEN d // 42875 <= 455 THEN 108 ELSE 144 END AS k36,
      CASE WHEN d <= 455 THEN d WHEN d // 35 <= 455 THEN d // 35 WHEN d // 1225 <= 455 THEN d // 1225 WHEN d // 42875 <= 455 THEN d // 42875
        ELSE d // 1500625 END AS dd
    FROM (SELECT w.*, greatest(1, least(26, 36 * w.j - w.bias)) AS t, (a.c - w.n) * (w.h + 1) + a.place - w.at AS fresh,
        coalesce(a.k, w.k) AS nk, coalesce(a.c, w.n) AS nn, coalesce(a.place + 1, w.at) AS nat,
        CASE WHEN w.k = 1 THEN w.delta // 700 ELSE w.delta // 2 END + CASE WHEN w.k = 1 THEN w.delta // 700 ELSE w.delta // 2 END // (w.h + 1) AS d
      FROM walk w LEFT JOIN added a ON a.l = w.l AND a.k = w.k + 1 AND w.q IS NULL WHERE w.q IS NOT NULL OR a.k IS NOT NULL))),
done AS (SELECT l, 'xn--' || arg_max(o, k) AS o FROM walk WHERE q IS NULL GROUP BY l)
SELECT id, string_agg(coalesce(o, parts.l), '.' ORDER BY n) AS host FROM parts LEFT JOIN done ON parts.l = done.l GROUP BY id"""
ORACLES["url_extension"] = f"""WITH {URL_X} SELECT k AS id,
  nullif(lower(CASE WHEN split_ok THEN regexp_extract({folded('path')}, '\\.[^.]*$') END), '') AS extension FROM u"""
ORACLES["resolve_href"] = f"WITH {HREF_X} SELECT k AS id, CASE WHEN ok THEN {rendered()} END AS url FROM t"
ORACLES["href_filter"] = f"SELECT id, href, {_WANTED} AS wanted FROM ({duck_fixture('href_x')}) h"
ORACLES["same_host_links"] = f"""WITH {HREF_X} SELECT t.k AS id, {rendered('t.')} AS url FROM t JOIN abs a ON a.id = t.k
WHERE t.ok AND t.host = a.base_host AND {_WANTED.replace('href', 'a.href')}"""

# -- content -----------------------------------------------------------------

CRAWL = f"src AS ({duck_fixture('crawl_x')})"


def category(c: str) -> str:
    m = f"lower({trim(f'split_part({c}, chr(59), 1)')})"
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' OR {m} IN ('text/html', 'application/xhtml+xml') THEN 'html' "
        f"WHEN {m} = 'application/pdf' THEN 'pdf' WHEN {m} = '{DOCX}' THEN 'docx' ELSE 'unsupported' END"
    )


def octets(c: str) -> str:
    return f"lower({trim(f'split_part({c}, chr(59), 1)')}) = 'application/octet-stream'"


def by_extension(c: str, path: str) -> str:
    return (
        f"CASE WHEN {octets(c)} AND lower(regexp_extract({path}, '\\.[^.]*$')) = '.pdf' THEN 'application/pdf' "
        f"WHEN {octets(c)} AND lower(regexp_extract({path}, '\\.[^.]*$')) = '.docx' THEN '{DOCX}' ELSE {c} END"
    )


def by_magic(c: str) -> str:
    return f"CASE WHEN {octets(c)} AND coalesce(hex(body)[1:10] = '255044462D', false) THEN 'application/pdf' ELSE {c} END"


CRAWL_URL = f"{CRAWL}, {url_ctes('src', 'page_id', 'url')}"
CRAWL_TYPED = f"""{CRAWL_URL}, ext AS (SELECT s.*, u.ok, u.web, u.scheme, u.host, {by_extension('s.content_type', 'u.path')} AS m1 FROM src s JOIN u ON u.k = s.page_id),
typed AS (SELECT *, {by_magic('m1')} AS media_type FROM ext),
cat AS (SELECT *, {category('media_type')} AS category FROM typed)"""

ORACLES["classify_content_type"] = f"WITH {CRAWL} SELECT page_id, content_type, {category('content_type')} AS category FROM src"
ORACLES["refine_by_extension"] = f"WITH {CRAWL_TYPED} SELECT page_id, m1 AS media_type FROM ext"
ORACLES["refine_by_magic"] = f"WITH {CRAWL} SELECT page_id, {by_magic('content_type')} AS media_type FROM src"
_EXT = "lower(regexp_extract(split_part(path, '/', -1), '\\.([^.]*)$', 1))"
ORACLES["resolve_kind"] = f"""SELECT path, CASE WHEN {_EXT} = 'docx' THEN 'docx'
  WHEN {_EXT} = 'pdf' AND hex(content)[1:10] = '255044462D' THEN 'pdf' END AS kind FROM ({duck_fixture('file_x')}) f"""
ORACLES["intake_limits"] = f"""SELECT path, length, CASE WHEN length > {INTAKE_CAP} THEN 413 WHEN {_EXT} NOT IN ('pdf', 'docx') THEN 415 END AS status,
  CASE WHEN length > {INTAKE_CAP} THEN 'File too large (max {INTAKE_CAP / 1048576:g}MB)' WHEN {_EXT} NOT IN ('pdf', 'docx') THEN 'Unsupported file type' END AS error
FROM ({duck_fixture('file_x')}) f"""
ORACLES["doc_intake"] = f"""WITH f AS (SELECT *, regexp_extract(path, '[^/]*$') AS url, {_EXT} AS ext, hex(content)[1:10] = '255044462D' AS pdf
  FROM ({duck_fixture('file_x')}) x), j AS (SELECT *, CASE WHEN length > {INTAKE_CAP} THEN 1 WHEN ext NOT IN ('pdf', 'docx') THEN 2
  WHEN ext = 'pdf' AND NOT pdf THEN 3 ELSE 0 END AS fault FROM f)
SELECT url, length, CASE WHEN fault = 0 THEN ext END AS kind, CASE fault WHEN 1 THEN 413 WHEN 2 THEN 415 WHEN 3 THEN 415 END AS status,
  CASE fault WHEN 1 THEN 'File too large (max {INTAKE_CAP / 1048576:g}MB)' WHEN 2 THEN 'Unsupported file type' WHEN 3 THEN 'File type mismatch' END AS error FROM j"""
_STATUS_ERR = (
    "CASE WHEN status NOT BETWEEN 200 AND 299 THEN 'Failed to process ' || upper(category) || ': ' || upper(category) || "
    "' fetch failed with status ' || CAST(status AS VARCHAR) END"
)
_SIZE_ERR = (
    f"CASE WHEN octet_length(body) > {BODY_CAP} THEN 'Failed to process ' || upper(category) || ': ' || upper(category) || ' too large: ' || "
    f"CAST(octet_length(body) AS VARCHAR) || ' bytes (max {BODY_CAP})' END"
)
_DOCS = "FROM cat WHERE category IN ('pdf', 'docx')"
ORACLES["body_size_cap"] = f"WITH {CRAWL_TYPED} SELECT page_id, category, octet_length(body) AS size, {_SIZE_ERR} AS error {_DOCS}"
ORACLES["document_status"] = f"WITH {CRAWL_TYPED} SELECT page_id, category, status, {_STATUS_ERR} AS error {_DOCS}"
ORACLES["unsupported_type"] = f"""WITH {CRAWL} SELECT page_id, 'Unsupported content type: ' || {trim("split_part(content_type, chr(59), 1)")} AS error
FROM src WHERE {category('content_type')} = 'unsupported'"""

# -- guard -------------------------------------------------------------------


def guard_sql(u: str, allow: str = "false") -> str:
    return (
        f"CASE WHEN NOT {u}.ok THEN 'Invalid URL' WHEN {u}.scheme IN ('file', 'data', 'ftp', 'gopher') THEN 'Protocol ' || {u}.scheme || ': is not allowed' "
        f"WHEN NOT ({allow}) AND {literal(f'{u}.host')} AND {private(f'{u}.host')} THEN '{_PRIVATE}' END"
    )


ORACLES["host_allow_join"] = f"""WITH {URL_X}, allowed AS (SELECT DISTINCT lower(host) AS host FROM ({duck_fixture('allowed_host')}) a),
r AS (SELECT u.*, u.split_ok AND u.host IN (SELECT host FROM allowed) AS hit FROM u)
SELECT k AS id, CASE WHEN split_ok THEN host END AS host, coalesce(hit, false) AS host_allowed, {guard_sql('r', 'coalesce(hit, false)')} AS guard_error FROM r"""
_CIDR_IP = f"regexp_extract({trim('cidr')}, '^([0-9.]+)/[0-9]{{1,2}}$', 1)"
CIDRS = f"""ranges AS (SELECT cidr, bits, ip - ip % CAST(pow(2, 32 - bits) AS BIGINT) AS lo FROM (SELECT cidr, {ip_int(_CIDR_IP)} AS ip,
  TRY_CAST(regexp_extract({trim('cidr')}, '/([0-9]{{1,2}})$', 1) AS INTEGER) AS bits FROM ({duck_fixture('cidr_x')}) c) d
  WHERE ip IS NOT NULL AND bits BETWEEN 0 AND 32)"""
ORACLES["parse_cidr"] = f"WITH {CIDRS} SELECT cidr, bits, lo, lo + CAST(pow(2, 32 - bits) AS BIGINT) - 1 AS hi FROM ranges"
ORACLES["cidr_allow_join"] = f"""WITH {CIDRS}, a AS (SELECT id, addr, {private('addr')} AS private, {ip_int('addr')} AS ip FROM ({duck_fixture('addr_x')}) x)
SELECT id, addr, private, private AND NOT EXISTS (SELECT 1 FROM ranges r WHERE a.ip BETWEEN r.lo AND r.lo + CAST(pow(2, 32 - r.bits) AS BIGINT) - 1) AS blocked FROM a"""


def bad_hosts(extra: str = "") -> str:
    return f"bad AS (SELECT DISTINCT lower(host) AS host FROM ({duck_fixture('dns_x')}) d WHERE {private('addr')} {extra})"


ORACLES["dns_guard"] = f"""WITH src AS (SELECT page_id, url FROM pages), {url_ctes('src', 'page_id', 'url')}, {bad_hosts()}
SELECT s.page_id, s.url, coalesce({guard_sql('u')}, CASE WHEN u.host IN (SELECT host FROM bad) THEN '{_PRIVATE}' END) AS guard_error
FROM src s JOIN u ON u.k = s.page_id"""
ORACLES["redirect_guard"] = f"""WITH {CRAWL}, {url_ctes('src', 'page_id', 'final_url')}, {bad_hosts()}
SELECT s.page_id, s.final_url, 'Redirect target blocked by SSRF guard: ' || s.final_url AS redirect_error FROM src s JOIN u ON u.k = s.page_id
WHERE s.final_url <> s.url AND ({guard_sql('u')} IS NOT NULL OR u.host IN (SELECT host FROM bad))"""

# The policy of the outcome queries lets 10.0.0.0/26 through.
_OPEN = "{0} BETWEEN 167772160 AND 167772223"


def judged_sql(cidr: bool = True, dns: bool = True, cap: int = BODY_CAP) -> str:
    """CTEs ending in `judged`: src columns plus category, outcome, http_status, status, error."""
    open_u = f"coalesce({_OPEN.format('(' + ip_int('c.host') + ')')}, false)" if cidr else "false"
    open_f = f"coalesce({_OPEN.format('(' + ip_int('f.host') + ')')}, false)" if cidr else "false"
    open_d = f"AND NOT coalesce({_OPEN.format('(' + ip_int('addr') + ')')}, false)" if cidr else ""
    named = "{0}.ok AND {0}.scheme NOT IN ('file','data','ftp','gopher') AND {0}.host IN (SELECT host FROM bad)" if dns else "false"
    bad = bad_hosts(open_d) + "," if dns else ""
    issue = (
        f"CASE WHEN coalesce({trim('c.url')}, '') = '' THEN 'The url field must be defined' WHEN NOT (c.ok AND c.web AND NOT regexp_matches(c.host, '[_ ]') AND "
        f"(regexp_full_match(c.host, '[^.].*\\.[a-z][a-z0-9\\-]+') OR {literal('c.host')})) THEN 'The url field must be a valid URL' END"
    )
    return f"""{CRAWL_TYPED}, {url_ctes('src', 'page_id', 'final_url', 'f')}, {bad}
facts AS (SELECT c.*, {issue} AS issue,
    coalesce({guard_sql('c', open_u)}, CASE WHEN {named.format('c')} THEN '{_PRIVATE}' END) AS guard_error,
    CASE WHEN c.final_url <> c.url AND ({guard_sql('f', open_f)} IS NOT NULL OR ({named.format('f')})) THEN
      'Redirect target blocked by SSRF guard: ' || c.final_url END AS redirect_error,
    coalesce({_STATUS_ERR.replace('status', 'c.status').replace('with c.status', 'with status').replace('category', 'c.category')},
      {_SIZE_ERR.replace(str(BODY_CAP), str(cap)).replace('category', 'c.category').replace('(body', '(c.body')}) AS doc_error
  FROM cat c JOIN f ON f.k = c.page_id),
named AS (SELECT *, CASE WHEN issue IS NOT NULL THEN 'invalid_url' WHEN guard_error IS NOT NULL THEN 'blocked'
    WHEN redirect_error IS NOT NULL THEN 'blocked_redirect' WHEN category = 'unsupported' THEN 'unsupported'
    WHEN fetch_error IS NOT NULL THEN 'fetch_failed' WHEN category <> 'html' AND doc_error IS NOT NULL THEN 'document_failed'
    WHEN category <> 'html' THEN 'needs_decoder' WHEN status >= 400 OR status = 0 THEN 'upstream_status' ELSE 'ok' END AS outcome FROM facts),
judged AS (SELECT page_id, url, final_url, html, category, outcome,
    CASE outcome WHEN 'invalid_url' THEN 422 WHEN 'blocked' THEN 403 WHEN 'blocked_redirect' THEN 403 WHEN 'unsupported' THEN 415
      WHEN 'fetch_failed' THEN 502 WHEN 'document_failed' THEN 502 WHEN 'upstream_status' THEN CASE status WHEN 0 THEN 502 ELSE status END
      WHEN 'ok' THEN 200 END AS http_status,
    CASE outcome WHEN 'invalid_url' THEN 422 WHEN 'blocked' THEN 403 WHEN 'blocked_redirect' THEN 403 WHEN 'unsupported' THEN 415
      WHEN 'fetch_failed' THEN 502 WHEN 'document_failed' THEN 502 WHEN 'upstream_status' THEN status WHEN 'ok' THEN 200 END AS status,
    CASE outcome WHEN 'invalid_url' THEN issue WHEN 'blocked' THEN guard_error WHEN 'blocked_redirect' THEN redirect_error
      WHEN 'unsupported' THEN 'Unsupported content type: ' || {trim("split_part(media_type, chr(59), 1)")}
      WHEN 'fetch_failed' THEN CASE category WHEN 'html' THEN 'Failed to fetch URL: ' ELSE 'Failed to process ' || upper(category) || ': ' END || fetch_error
      WHEN 'document_failed' THEN doc_error WHEN 'upstream_status' THEN 'URL returned non-success status' END AS error FROM named)"""


JUDGED = judged_sql()
ORACLES["page_outcomes"] = f"WITH {JUDGED} SELECT page_id, category, outcome, http_status, status, error FROM judged"
ORACLES["page_errors"] = f"WITH {JUDGED} SELECT page_id, url, error, status, http_status FROM judged WHERE error IS NOT NULL"
ORACLES["fetch_failures"] = f"WITH {JUDGED} SELECT page_id, http_status, status, error FROM judged WHERE outcome = 'fetch_failed'"
ORACLES["status_filter"] = f"""WITH {CRAWL}, {url_ctes('src', 'page_id', 'url')}, ok AS (SELECT s.* FROM src s JOIN u ON u.k = s.page_id
  WHERE u.ok AND u.web AND {_ISSUE} IS NULL AND {guard_sql('u')} IS NULL)
SELECT page_id, CASE status WHEN 0 THEN 502 ELSE status END AS http_status, status, 'URL returned non-success status' AS error
FROM ok WHERE status >= 400 OR status = 0""".replace("{_ISSUE}", _ISSUE)

# -- small functions ---------------------------------------------------------

ORACLES["flag_words"] = f"SELECT id, coalesce({trim('flag')} IN ('true', '1'), false) AS flag FROM ({duck_fixture('flag_x')}) f"
_ITEMS = f"[{trim('x')} FOR x IN string_split(coalesce(list, ''), ',') IF {trim('x')} <> '']"
ORACLES["comma_list"] = f"SELECT id, len({_ITEMS}) AS n_items, array_to_string({_ITEMS}, '|') AS items FROM ({duck_fixture('flag_x')}) f"


def decoded(c: str) -> str:
    """The references that occur in the fixtures; the ampersand comes last."""
    for ref, char in (
        ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
        ("&#233;", "é"), ("&#x1F600;", "😀"), ("&#0;", "�"), ("&#128;", "€"),
        ("&#x11111111111111111111;", "\ufffd"), ("&#99999999999999999999;", "\ufffd"), ("&#x00000000000000000041;", "A"), ("&amp;", "&"),
    ):
        c = f"replace({c}, '{ref}', '{char}')"
    return c


ORACLES["decode_entities"] = f"SELECT page_id, {decoded('html')} AS text FROM ({duck_fixture('html_mix_x')}) h"
_TITLE = f"nullif({trim(decoded(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)'))}, '')"
ORACLES["page_title"] = f"SELECT page_id, {_TITLE} AS title FROM pages"

# -- limits ------------------------------------------------------------------

LOG = """log AS (SELECT event_id, user_id AS key, ts, date_trunc('day', ts)::TIMESTAMP AS window_start FROM events),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, window_start ORDER BY ts, event_id) AS n FROM log)"""
BLOCKS = f"""{LOG}, opened AS (SELECT key, ts AS f, ts + INTERVAL 12 HOUR AS t FROM ranked WHERE n = {REQUESTS + 1}),
marked AS (SELECT *, CASE WHEN f <= max(t) OVER (PARTITION BY key ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM opened),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY f, t) AS island FROM marked),
blocks AS (SELECT key, min(f) AS blocked_from, max(t) AS blocked_until FROM islands GROUP BY key, island)"""
ORACLES["request_counts"] = f"WITH {LOG} SELECT key, window_start, count(*) AS n_requests FROM log GROUP BY ALL"
ORACLES["stream_request_counts"] = f"""WITH {LOG}, late AS (SELECT max(ts) - INTERVAL 1 HOUR AS t FROM events)
SELECT key, window_start, count(*) AS n_requests FROM log, late WHERE window_start + INTERVAL 1 DAY <= t GROUP BY key, window_start"""
ORACLES["over_limit_requests"] = f"WITH {LOG} SELECT event_id, key, ts, window_start FROM ranked WHERE n > {REQUESTS}"
ORACLES["block_intervals"] = f"WITH {BLOCKS} SELECT key, blocked_from, blocked_until FROM blocks"
ORACLES["stream_block_intervals"] = f"""WITH {BLOCKS}, late AS (SELECT max(ts) - INTERVAL 1 HOUR AS t FROM events)
SELECT key, blocked_from, blocked_until FROM blocks, late WHERE date_trunc('day', blocked_until) + INTERVAL 1 DAY <= t"""
ORACLES["blocked_requests"] = f"""WITH {BLOCKS} SELECT event_id, key, ts FROM log l WHERE EXISTS (
  SELECT 1 FROM blocks b WHERE b.key = l.key AND l.ts > b.blocked_from AND l.ts <= b.blocked_until)"""

# -- pages as token rows -----------------------------------------------------

_S = r"[ \t\r\n\f]"
_TAIL = """(?:[^>"'']+|"[^"]*"|''[^'']*''|["''])*(?:>|\\z)"""
_OPAQUE = "|".join(
    [r"<!--.*?(?:-->|\z)"]
    + [rf"<{t}(?:[ \t\r\n\f/][^>]*)?>.*?(?:</{t}[ \t\r\n\f]*>|\z)" for t in ("script", "style", "title")]
)
_TOKEN = rf"(?is){_OPAQUE}|</?[a-z]{_TAIL}|<[!?/][^>]*(?:>|\z)|[^<]+|<"
_VOID = "'area','base','br','col','embed','hr','img','input','link','meta','param','source','track','wbr'"
_BLOCK = (
    "'address','article','aside','blockquote','body','center','dd','details','dialog','dir','div','dl','dt','fieldset',"
    "'figcaption','figure','footer','form','h1','h2','h3','h4','h5','h6','head','header','hgroup','hr','html','legend',"
    "'li','main','menu','nav','noscript','ol','optgroup','option','p','pre','search','section','select','summary','ul',"
    "'table','thead','tbody','tfoot','tr','td','th'"
)
_TABLE = "'table','thead','tbody','tfoot','tr','td','th'"
_LISTS = "'ul','ol','menu','dir'"


def token_ctes(source: str) -> str:
    return f"""src AS ({source}),
tl AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS l FROM src),
tok AS (SELECT page_id, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM tl),
tagged AS (SELECT *, CASE WHEN raw[-1] = '>' THEN lower(regexp_extract(raw, '^</?([a-zA-Z][^ \\t\\r\\n\\f/>]*)', 1)) ELSE '' END AS tag FROM tok),
kinds AS (SELECT *, CASE WHEN raw[1] <> '<' OR length(raw) = 1 THEN 'text' WHEN tag = '' OR tag IN ('script','style','title') THEN 'drop'
  WHEN raw[2] = '/' THEN 'close' WHEN tag IN ({_VOID}) THEN 'void' ELSE 'open' END AS kind FROM tagged)"""


def attr(name: str, raw: str = "raw") -> str:
    """Attribute value from the list of all attributes of a tag; null if absent."""
    one = rf"""[ \t\r\n\f/]+[^ \t\r\n\f/>=]+(?:{_S}*={_S}*(?:"[^"]*"|''[^'']*''|[^ \t\r\n\f>]*))?"""
    found = (
        f"[a FOR a IN regexp_extract_all(regexp_replace({raw}, '^<[a-zA-Z][^ \\t\\r\\n\\f/>]*', ''), '{one}') "
        f"IF regexp_matches(a, '(?is)^[ \\t\\r\\n\\f/]+{name}({_S}*=.*)?$')][1]"
    )
    value = f"regexp_replace(CASE WHEN contains({found}, '=') THEN regexp_replace({found}, '(?s)^[^=]*={_S}*', '') ELSE '' END, "
    bare = value + """'(?s)^(?:"(.*)"|''(.*)'')$', '\\1\\2')"""
    return f"CASE WHEN {found} IS NOT NULL THEN {decoded(bare)} END"


def _mark(n: int) -> str:
    return f"chr({n})"


_ESC = r"([\\*_\[\]`])"


def block_ctes(source: str, base: bool = False) -> str:
    """CTEs ending in `shaped`: one row per block with text and structure."""
    w = "OVER (PARTITION BY page_id ORDER BY pos)"
    sig = f"((edge AND NOT tab) OR (tag = 'table' AND kind IN ('open', 'close')))"
    href = attr("href")
    if base:
        # Page links of the given tables are absolute paths on the page's host.
        href = f"CASE WHEN starts_with({href}, '/') THEN site || {encoded(href, _PATH_SAFE)} ELSE {href} END"
    title = attr("title")
    quoted = f"""CASE WHEN coalesce({title}, '') = '' THEN '' ELSE ' "' || replace({title}, '"', '\\"') || '"' END"""
    lang = rf"regexp_extract(coalesce({attr('class')}, ''), '(?:^|{_S})language-([^ \t\r\n\f]+)', 1)"
    spans = "".join(
        f"WHEN tag IN ({tags}) THEN CASE kind WHEN 'open' THEN {_mark(o)} ELSE {_mark(c)} END "
        for tags, o, c in (("'strong','b'", 4, 5), ("'em','i'", 6, 7), ("'del','s','strike'", 14, 15))
    )
    piece = f"""CASE WHEN in_head THEN '' WHEN kind = 'drop' THEN ''
    WHEN kind = 'text' THEN regexp_replace({decoded('raw')}, '{_ESC}', '\\\\\\1', 'g')
    WHEN edge THEN '' WHEN tag = 'br' THEN chr(1)
    WHEN tag = 'a' AND kind = 'close' THEN chr(18)
    WHEN tag = 'a' THEN CASE WHEN {attr('href')} IS NULL THEN '' ELSE chr(16) || {href} || {quoted} || chr(17) END
    WHEN tag = 'code' THEN CASE kind WHEN 'close' THEN chr(3) ELSE chr(2) || {lang} || chr(23) END {spans}
    WHEN tag = 'img' THEN CASE WHEN coalesce({attr('src')}, '') = '' THEN '' ELSE
      chr(19) || '![' || coalesce({attr('alt')}, '') || '](' || {attr('src')} || {quoted} || ')' || chr(20) END
    WHEN tag = 'input' AND lower({attr('type')}) = 'checkbox' THEN CASE WHEN {attr('checked')} IS NULL THEN chr(22) ELSE chr(21) END
    ELSE '' END"""
    text = f"CASE WHEN in_head THEN '' WHEN kind = 'text' THEN {decoded('raw')} WHEN tag = 'br' OR cellmark THEN ' ' ELSE '' END"
    unspaced = r"\p{{Han}}\p{{Hiragana}}\p{{Katakana}}\p{{Thai}}\p{{Lao}}\p{{Khmer}}\p{{Myanmar}}"
    words = rf"len(regexp_extract_all({{0}}, '[{unspaced}]|[^ \t\r\n\f\x{{{{A0}}}}{unspaced}]+'))"

    def span(s: str, o: int, c: int, mark: str) -> str:
        ho, hc = f"\\x{o:02X}", f"\\x{c:02X}"
        bare = f"replace(replace(g, chr({o}), ''), chr({c}), '')"
        return (
            f"CASE WHEN contains({s}, chr({o})) OR contains({s}, chr({c})) THEN array_to_string([CASE WHEN starts_with(g, chr({o})) AND "
            f"regexp_matches({bare}, '[^ \\x01-\\x1F]') THEN regexp_replace({bare}, '(?s)^([ \\x01]*)(.*?)([ \\x01]*)$', '\\1{mark}\\2{mark}\\3') "
            f"ELSE {bare} END FOR g IN regexp_extract_all({s}, '{ho}[^{hc}]*{hc}?|[^{ho}]+')], '') ELSE {s} END"
        )

    code_inner = (
        r"regexp_replace(replace(regexp_replace(g, '\x10[^\x11]*\x11|\x02[^\x17]*\x17|[\x02-\x1F]', '', 'g'), chr(1), ' '), "
        r"'\\([\\*_\[\]`])', '\1', 'g')"
    )
    code = (
        f"CASE WHEN contains(s, chr(2)) OR contains(s, chr(3)) THEN array_to_string([CASE WHEN NOT starts_with(g, chr(2)) THEN replace(g, chr(3), '') "
        f"WHEN trim({code_inner}) = '' THEN '' WHEN contains({code_inner}, '`') THEN '`` ' || {code_inner} || ' ``' ELSE '`' || {code_inner} || '`' END "
        r"FOR g IN regexp_extract_all(s, '\x02[^\x03]*\x03?|[^\x02]+')], '') ELSE s END"
    )
    pre = (
        r"regexp_replace(regexp_replace(replace(regexp_replace(body, '\x10[^\x11]*\x11|\x02[^\x17]*\x17|[\x02-\x08\x0E-\x1F]', '', 'g'), "
        r"chr(1), chr(10)), '\\([\\*_\[\]`])', '\1', 'g'), '^\r?\n|[ \t\r\n]+$', '', 'g')"
    )
    run = "OVER (PARTITION BY page_id ORDER BY block_id)"
    return f"""{token_ctes(source)},
edges AS (SELECT k.*, {"s.site," if base else ""} tag IN ({_BLOCK}) AND kind IN ('open','close','void') AS edge, tag IN ({_TABLE}) AS tab FROM kinds k
  {"JOIN src s USING (page_id)" if base else ""}),
sig AS (SELECT page_id, pos, tag = 'table' AND kind = 'open' AND coalesce(lead(tag = 'table' AND kind = 'close') {w}, false) AS data_open FROM edges WHERE {sig}),
st AS (SELECT e.*, g.data_open, g.pos IS NOT NULL AS is_sig FROM edges e LEFT JOIN sig g USING (page_id, pos)),
st2 AS (SELECT *, coalesce(last_value(CASE WHEN is_sig THEN data_open END IGNORE NULLS) {w}, false) AS in_data,
  coalesce(last_value(CASE WHEN is_sig AND tag <> 'noscript' THEN tag = 'head' AND kind = 'open' END IGNORE NULLS) {w}, false) AS in_head FROM st),
st3 AS (SELECT *, (edge AND NOT tab) OR (tag = 'table' AND edge) OR (tag IN ('tr','td','th') AND kind = 'open' AND NOT in_data) AS starts,
  in_data AND tag IN ('tr','td','th') AND kind = 'open' AS cellmark FROM st2),
st4 AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) {w} AS block_id, sum(CASE WHEN cellmark THEN 1 ELSE 0 END) {w} AS part,
  CASE WHEN starts AND tag = 'table' THEN CASE WHEN data_open THEN 'table' ELSE '' END WHEN starts AND tab THEN '' WHEN starts THEN tag END AS head_tag FROM st3),
st5 AS (SELECT *, {piece} AS piece, {text} AS txt,
  last_value(CASE WHEN tag = 'a' AND kind = 'close' THEN 0 WHEN tag = 'a' AND kind = 'open' AND {attr('href')} IS NOT NULL THEN 1 END IGNORE NULLS)
    OVER (PARTITION BY page_id, block_id ORDER BY pos) AS in_link FROM st4),
blk AS (SELECT page_id, block_id, max(head_tag) AS tag, coalesce(max(CASE WHEN starts THEN kind = 'close' END), false) AS closing,
  max(CASE WHEN starts THEN raw END) AS head, string_agg(CASE WHEN cellmark THEN ' ' ELSE piece END, '' ORDER BY pos) AS body,
  string_agg(txt, '' ORDER BY pos) AS txt,
  string_agg(CASE WHEN tag = 'a' AND kind = 'open' THEN ' ' WHEN in_link = 1 THEN txt ELSE '' END, '' ORDER BY pos) AS link_txt
  FROM st5 GROUP BY page_id, block_id),
blk2 AS (SELECT *, regexp_matches(body, '[^ \\t\\r\\n\\f\\x{{A0}}\\x01-\\x14\\x17-\\x1F]') OR (tag = 'hr' AND NOT closing) AS shows,
  {words.format('txt')} AS words, {words.format('link_txt')} AS link_words FROM blk),
prt AS (SELECT page_id, block_id, part, max(CASE WHEN cellmark THEN tag END) AS mark,
  regexp_replace(string_agg(piece, '' ORDER BY pos), '[ \\t\\r\\n\\f]+', ' ', 'g') AS s FROM st5 GROUP BY page_id, block_id, part),
i1 AS (SELECT * REPLACE (regexp_replace(regexp_replace(s, '(^|\\x01)( ?)(#{{1,6}} |>|-|\\+ |=+|~~~)', '\\1\\2\\\\\\3', 'g'), '(^|\\x01)( ?[0-9]+)\\. ', '\\1\\2\\\\. ', 'g') AS s) FROM prt),
i2 AS (SELECT * REPLACE ({code} AS s) FROM i1),
i3 AS (SELECT * REPLACE ({span('s', 4, 5, '**')} AS s) FROM i2),
i4 AS (SELECT * REPLACE ({span('s', 6, 7, '_')} AS s) FROM i3),
i5 AS (SELECT * REPLACE ({span('s', 14, 15, '~~')} AS s) FROM i4),
i6 AS (SELECT * REPLACE (replace(replace(regexp_replace(s, '\\x10([^\\x11]*)\\x11([^\\x10\\x12]*)\\x12?', '[\\2](\\1)', 'g'), chr(21), '[x] '), chr(22), '[ ] ') AS s) FROM i5),
inl AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[\\x02-\\x1F]', '', 'g'), ' *\\x01 *', chr(1), 'g'), ' +', ' ', 'g'), '^[ \\x01]+|[ \\x01]+$', '', 'g') AS s) FROM i6),
rws AS (SELECT *, sum(CASE WHEN mark = 'tr' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, block_id ORDER BY part) AS r FROM inl),
lines AS (SELECT page_id, block_id, r, count(*) AS n, bool_or(mark = 'th') AS headed,
  '| ' || string_agg(replace(replace(s, chr(1), ' '), '|', '\\|'), ' | ' ORDER BY part) || ' |' AS line FROM rws WHERE mark IN ('td', 'th') AND r > 0 GROUP BY ALL),
line2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY r) AS i FROM lines),
grid AS (SELECT page_id, block_id, string_agg(CASE WHEN i = 1 AND headed THEN line || chr(10) || '| ' || array_to_string(list_transform(range(n), lambda x: '---'), ' | ') || ' |'
    WHEN i = 1 THEN '| ' || array_to_string(list_transform(range(n), lambda x: ''), ' | ') || ' |' || chr(10) || '| ' ||
      array_to_string(list_transform(range(n), lambda x: '---'), ' | ') || ' |' || chr(10) || line ELSE line END, chr(10) ORDER BY i) AS g FROM line2 GROUP BY ALL),
lead_ AS (SELECT page_id, block_id, s FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY part) AS i FROM inl) WHERE i = 1),
txt AS (SELECT b.*, CASE WHEN NOT b.shows THEN ''
    WHEN NOT closing AND regexp_matches(tag, '^h[1-6]$') THEN CASE WHEN l.s = '' THEN '' ELSE repeat('#', CAST(tag[2] AS INTEGER)) || ' ' || replace(l.s, chr(1), ' ') END
    WHEN NOT closing AND tag = 'pre' THEN CASE WHEN {pre} = '' THEN '' ELSE '```' || coalesce(nullif(regexp_extract(body, '\\x02([^\\x17]+)\\x17', 1), ''),
      regexp_extract(coalesce({attr('class', 'head')}, ''), '(?:^|{_S})language-([^ \\t\\r\\n\\f]+)', 1)) || chr(10) || {pre} || chr(10) || '```' END
    WHEN NOT closing AND tag = 'table' THEN concat_ws(chr(10) || chr(10), nullif(replace(l.s, chr(1), '  ' || chr(10)), ''), g.g)
    WHEN NOT closing AND tag = 'hr' THEN concat_ws(chr(10) || chr(10), '* * *', nullif(replace(l.s, chr(1), '  ' || chr(10)), ''))
    ELSE replace(l.s, chr(1), '  ' || chr(10)) END AS text,
    CASE WHEN NOT closing AND tag = 'h1' THEN trim(regexp_replace(txt, '[ \\t\\r\\n\\f\\x{{A0}}]+', ' ', 'g')) END AS h1
  FROM blk2 b LEFT JOIN lead_ l USING (page_id, block_id) LEFT JOIN grid g USING (page_id, block_id)),
step AS (SELECT *, coalesce(tag IN ({_LISTS}), false) AS is_list, coalesce(tag = 'li' AND NOT closing, false) AS is_item FROM txt),
dep AS (SELECT *, sum(CASE WHEN is_list THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) {run} AS ls,
  sum(CASE WHEN tag = 'blockquote' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) {run} AS qs,
  sum(CASE WHEN is_item THEN 1 ELSE 0 END) {run} AS item FROM step),
dep2 AS (SELECT *, CAST(ls - least(0, min(ls) {run}) AS BIGINT) AS list_depth, CAST(qs - least(0, min(qs) {run}) AS BIGINT) AS quote_depth FROM dep),
own AS (SELECT *, last_value(CASE WHEN is_list AND NOT closing THEN block_id END IGNORE NULLS) OVER (PARTITION BY page_id, list_depth ORDER BY block_id) AS list_id FROM dep2),
nth AS (SELECT o.*, sum(CASE WHEN is_item THEN 1 ELSE 0 END) OVER (PARTITION BY o.page_id, o.list_depth, o.list_id ORDER BY o.block_id) AS n,
  p.tag AS list_tag, coalesce(TRY_CAST({attr('start', 'p.head')} AS INTEGER), 1) AS list_start FROM own o LEFT JOIN txt p ON p.page_id = o.page_id AND p.block_id = o.list_id),
num AS (SELECT *, max(CASE WHEN is_item AND list_depth > 0 AND list_tag = 'ol' THEN CAST(list_start + n - 1 AS BIGINT) END) OVER (PARTITION BY page_id, item ORDER BY block_id) AS number,
  shows AND text <> '' AND item > 0 AND list_depth > 0 AND
    sum(CASE WHEN shows AND text <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, item ORDER BY block_id) = 1 AS leads_item FROM nth),
ind AS (SELECT *, CASE WHEN leads_item THEN repeat('    ', list_depth - 1) || coalesce(CAST(number AS VARCHAR) || '.  ', '-   ') || replace(text, chr(10), chr(10) || repeat('    ', list_depth))
    WHEN list_depth > 0 AND item > 0 THEN repeat('    ', list_depth) || replace(text, chr(10), chr(10) || repeat('    ', list_depth)) ELSE text END AS t1 FROM num),
shaped AS (SELECT *, CASE WHEN text = '' THEN '' ELSE repeat('> ', quote_depth) || replace(t1, chr(10), chr(10) || repeat('> ', quote_depth)) END AS md FROM ind)"""


KEEP = """near AS (SELECT *, lag(words, 1, 0) OVER w AS pw, lag(link_words, 1, 0) OVER w AS pl, lead(words, 1, 0) OVER w AS nw
  FROM shaped WHERE shows WINDOW w AS (PARTITION BY page_id ORDER BY block_id)),
kept AS (SELECT *, CASE WHEN 3 * link_words > words THEN false WHEN 9 * pl <= 5 * pw THEN words > 16 OR nw > 15 OR pw > 4 ELSE words > 40 OR nw > 17 END AS main FROM near),
chosen AS (SELECT *, NOT bool_or(main) OVER (PARTITION BY page_id) AS fallback FROM kept)"""
ALL_KEPT = "chosen AS (SELECT *, true AS main, true AS fallback FROM shaped WHERE shows)"
JOINED = """part_rows AS (SELECT *, lag(quote_depth) OVER w AS q0, lag(list_depth) OVER w AS l0 FROM chosen WHERE (main OR fallback) AND text <> ''
  WINDOW w AS (PARTITION BY page_id ORDER BY block_id)),
pages_md AS (SELECT page_id, string_agg(CASE WHEN q0 IS NULL THEN '' WHEN leads_item AND l0 > 0 THEN chr(10)
    ELSE chr(10) || rtrim(repeat('> ', least(q0, quote_depth))) || chr(10) END || md, '' ORDER BY block_id) AS markdown,
  arg_min(h1, block_id) FILTER (h1 <> '' AND NOT fallback) AS article_title FROM part_rows GROUP BY page_id)"""
_PAGES = "SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+') AS site FROM pages"
NUMBERED = "row_number() OVER (PARTITION BY page_id ORDER BY block_id)"

ORACLES["token_blocks"] = f"""WITH {token_ctes('SELECT page_id, html FROM pages')} SELECT page_id, pos, kind, tag,
  CAST(sum(CASE WHEN tag IN ({_BLOCK}) AND kind IN ('open','close','void') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS BIGINT) AS block_id FROM kinds"""
_DEPTH = "sum(CASE WHEN {0} AND kind = 'open' THEN 1 WHEN {0} AND kind = 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos)"
ORACLES["token_depth"] = f"""WITH {token_ctes(duck_fixture('html_list_x'))},
d AS (SELECT page_id, pos, {_DEPTH.format(f'tag IN ({_LISTS})')} AS l, {_DEPTH.format("tag = 'blockquote'")} AS q FROM kinds)
SELECT page_id, pos, CAST(l - least(0, min(l) OVER w) AS BIGINT) AS list_depth, CAST(q - least(0, min(q) OVER w) AS BIGINT) AS quote_depth FROM d
WINDOW w AS (PARTITION BY page_id ORDER BY pos)"""
PAGE_BLOCKS = block_ctes(_PAGES, base=True)
ALL_SCRIPTS = block_ctes(f"SELECT page_id, html FROM pages UNION ALL {duck_fixture('unspaced_x')}")
ORACLES["block_features"] = f"WITH {ALL_SCRIPTS} SELECT page_id, {NUMBERED} AS block_no, words, link_words FROM shaped WHERE shows"
ORACLES["main_content_blocks"] = f"WITH {ALL_SCRIPTS}, {KEEP} SELECT page_id, {NUMBERED} AS block_no, main AS keep FROM chosen"
_FALLBACK = "SELECT page_id, html FROM pages UNION ALL SELECT -1 - page_id, regexp_extract(html, '<nav>.*</nav>') FROM pages"
ORACLES["content_fallback"] = f"""WITH {block_ctes(_FALLBACK)}, {KEEP}
SELECT page_id, bool_or(fallback) AS fallback, count(*) FILTER (main OR fallback) AS n_kept, count(*) AS n_blocks FROM chosen GROUP BY page_id"""
ORACLES["page_markdown"] = f"WITH {PAGE_BLOCKS}, {KEEP}, {JOINED} SELECT page_id, markdown FROM pages_md"
ORACLES["article_title"] = f"""WITH {PAGE_BLOCKS}, {KEEP}, {JOINED}
SELECT p.page_id, coalesce(m.article_title, {_TITLE}) AS title FROM pages p LEFT JOIN pages_md m USING (page_id)"""
FIXTURE_BLOCKS = {f: block_ctes(duck_fixture(f)) for f in ("html_mix_x", "html_list_x", "html_table_x")}
ORACLES["list_items"] = f"""WITH {FIXTURE_BLOCKS['html_list_x']} SELECT page_id, {NUMBERED} AS item_no, number, list_depth, text FROM shaped WHERE leads_item"""
for _name, (_fixture, _test) in MD_RULES.items():
    ORACLES[_name] = f"""WITH {FIXTURE_BLOCKS[_fixture]}, numbered AS (SELECT *, NOT closing AS opened, {NUMBERED} AS block_no FROM shaped WHERE shows AND text <> '')
SELECT page_id, block_no, md FROM numbered WHERE {_test}"""
ORACLES["md_paragraphs"] = f"WITH {FIXTURE_BLOCKS['html_mix_x']}, {ALL_KEPT}, {JOINED} SELECT page_id, markdown FROM pages_md"
ORACLES["md_dropped"] = f"""WITH {FIXTURE_BLOCKS['html_mix_x']}, {ALL_KEPT}, {JOINED}
SELECT page_id, length(markdown) AS n_chars, regexp_matches(markdown, '<script|<style|<!--|track\\(|margin:') AS leaks FROM pages_md"""

# -- links -------------------------------------------------------------------


def anchor_ctes(source: str) -> str:
    """CTEs ending in `anchors`: page_id, url, anchor_no, href, text, rel."""
    return f"""{token_ctes(source)},
marks AS (SELECT *, CASE WHEN tag = 'a' AND kind = 'open' THEN pos WHEN tag = 'a' AND kind = 'close' THEN -1 END AS m FROM kinds),
runs AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos) AS a FROM marks),
grp AS (SELECT page_id, a, max(CASE WHEN pos = a THEN raw END) AS raw,
  {trim("string_agg(CASE WHEN kind = 'text' THEN " + decoded('raw') + " ELSE '' END, '' ORDER BY pos)")} AS text
  FROM runs WHERE a >= 0 GROUP BY page_id, a),
flds AS (SELECT page_id, a, text, {attr('href')} AS href, nullif({attr('rel')}, '') AS rel FROM grp),
anchors AS (SELECT f.page_id, s.url, CAST(row_number() OVER (PARTITION BY f.page_id ORDER BY a) - 1 AS INTEGER) AS anchor_no, href, text, rel
  FROM flds f JOIN src s ON s.page_id = f.page_id WHERE href IS NOT NULL)"""


def link_ctes(source: str, url: str = "url") -> str:
    """CTEs ending in `link`: page_id, host, anchor_no, url, path, text, rel of same-host links."""
    return f"""{anchor_ctes(source)},
{url_ctes('src', 'page_id', url, 'lb')},
labs AS (SELECT a.page_id * 100000 + a.anchor_no AS lk, a.page_id, a.anchor_no, a.text, a.rel, lb.host AS base_host, {resolved(trim('a.href'), 'lb')} AS target
  FROM anchors a JOIN lb ON lb.k = a.page_id WHERE {_WANTED.replace('href', 'a.href')}),
{url_ctes('labs', 'lk', 'target', 'lt')},
link AS (SELECT l.page_id, l.base_host AS host, l.anchor_no, l.text, l.rel, lt.path AS path, {rendered('lt.')} AS url
  FROM labs l JOIN lt ON lt.k = l.lk WHERE lt.ok AND lt.host = l.base_host),
link_lists AS (SELECT page_id, count(*) AS n_links,
  string_agg(concat_ws(' ', url, text, coalesce(rel, '-')), chr(10) ORDER BY anchor_no) AS links FROM link GROUP BY page_id)"""


ORACLES["anchor_fields"] = f"WITH {anchor_ctes(duck_fixture('anchor_x'))} SELECT page_id, anchor_no, href, text, rel FROM anchors"
LINKS = link_ctes("SELECT page_id, url, html FROM pages")
ORACLES["page_links"] = f"""WITH {LINKS} SELECT p.page_id, coalesce(n_links, 0) AS n_links, coalesce(links, '') AS links
FROM pages p LEFT JOIN link_lists USING (page_id)"""
_COUNTS = "counts AS (SELECT host, regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1) AS target, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM link GROUP BY ALL)"
ORACLES["host_link_counts"] = f"WITH {LINKS}, {_COUNTS} SELECT host, target, n_links, n_pages FROM counts"
ORACLES["top_targets"] = f"""WITH {LINKS}, {_COUNTS}, best AS (SELECT *, CAST(row_number() OVER (PARTITION BY host
  ORDER BY n_links DESC, n_pages DESC, target) AS INTEGER) AS place FROM counts) SELECT host, target, n_links, n_pages, place FROM best WHERE place <= 3"""
ORACLES["crawl_frontier"] = f"""WITH {LINKS} SELECT regexp_replace(url, '#.*$', '') AS url, count(DISTINCT page_id) AS n_pages FROM link
WHERE regexp_replace(url, '#.*$', '') NOT IN (SELECT regexp_replace(url, '#.*$', '') FROM pages WHERE page_id % 2 = 0) GROUP BY ALL"""

# -- selection ---------------------------------------------------------------

# One pass of plain SQL per selector of the fixture; an element ends where the
# count of its own tag comes back to the level before it.
ORACLES["select_content"] = f"""WITH {token_ctes(duck_fixture('select_x'))},
t AS (SELECT k.*, CASE s.selector WHEN 'h9 , article' THEN 'article' WHEN 'div[class="ad"]' THEN '.ad' WHEN 'nav ul a' THEN 'nav a'
    WHEN 'body nav li' THEN 'nav li' WHEN 'ul > li' THEN 'nav li' ELSE s.selector END AS selector, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY k.page_id, tag ORDER BY pos) AS d
  FROM kinds k JOIN src s USING (page_id)),
cand AS (SELECT page_id, pos, d, tag FROM t WHERE kind = 'open' AND CASE selector WHEN 'h1' THEN tag = 'h1' WHEN 'div.ad' THEN tag = 'div' AND raw LIKE '%class="ad"%'
  WHEN '.ad' THEN raw LIKE '%class="ad"%' WHEN 'nav a' THEN tag = 'a' WHEN 'article' THEN tag = 'article' WHEN 'nav ul' THEN tag = 'ul' WHEN 'nav li' THEN tag = 'li'
  WHEN 'article h1' THEN tag = 'h1' ELSE false END),
first_ AS (SELECT c.page_id, min(c.pos) AS p FROM cand c JOIN (SELECT DISTINCT page_id, selector FROM t) s USING (page_id) WHERE NOT contains(s.selector, ' ') OR EXISTS (
  SELECT 1 FROM t o WHERE o.page_id = c.page_id AND o.tag = split_part(s.selector, ' ', 1) AND o.kind = 'open' AND o.pos < c.pos AND NOT EXISTS (
    SELECT 1 FROM t x WHERE x.page_id = o.page_id AND x.tag = o.tag AND x.kind = 'close' AND x.d = o.d - 1 AND x.pos > o.pos AND x.pos < c.pos)) GROUP BY c.page_id),
range_ AS (SELECT f.page_id, f.p, (SELECT min(x.pos) FROM t x JOIN t o ON o.page_id = x.page_id AND o.pos = f.p
  WHERE x.page_id = f.page_id AND x.tag = o.tag AND x.kind = 'close' AND x.pos > f.p AND x.d = o.d - 1) AS e FROM first_ f)
SELECT s.page_id, s.selector, true AS supported, coalesce((SELECT string_agg(raw, '' ORDER BY pos) FROM t JOIN range_ r ON r.page_id = t.page_id
  WHERE t.page_id = s.page_id AND t.pos > r.p AND (r.e IS NULL OR t.pos < r.e)), '') AS content FROM src s"""

# Elements as intervals: an element without an end tag ends with the paired one
# around it, a paragraph where the next one starts.
_ELEMENTS = """
lv AS (SELECT k.*, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY page_id, tag ORDER BY pos) AS d
  FROM kinds k WHERE kind IN ('open', 'close', 'void')),
own AS (SELECT o.*, (SELECT min(c.pos) FROM lv c WHERE c.page_id = o.page_id AND c.tag = o.tag AND c.kind = 'close' AND c.pos > o.pos AND c.d = o.d - 1
  AND NOT (o.tag = 'p' AND EXISTS (SELECT 1 FROM lv x WHERE x.page_id = o.page_id AND x.tag = 'p' AND x.kind = 'open' AND x.pos > o.pos AND x.pos < c.pos))) AS own_end
  FROM lv o WHERE kind <> 'close'),
outer_ AS (SELECT e.*, (SELECT min(a.own_end) FROM own a WHERE a.page_id = e.page_id AND a.tag <> 'p' AND a.pos < e.pos AND a.own_end > e.pos) AS outer_end,
  (SELECT min(n.pos) FROM own n WHERE n.page_id = e.page_id AND n.tag = 'p' AND n.pos > e.pos) AS next_p FROM own e),
els AS (SELECT page_id, pos, tag, raw, kind, CASE WHEN kind = 'void' THEN pos ELSE coalesce(least(coalesce(own_end, outer_end),
  CASE WHEN tag IN ('p', 'b') THEN next_p END, outer_end), 1000000000) END AS post FROM outer_),
tree AS (SELECT e.*, (SELECT max(a.pos) FROM els a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.post > e.pos) AS parent FROM els e),
placed AS (SELECT *, row_number() OVER (PARTITION BY page_id, parent ORDER BY pos) AS nth, lag(pos) OVER (PARTITION BY page_id, parent ORDER BY pos) AS before,
  count(*) OVER (PARTITION BY page_id, parent) AS n FROM tree)"""
# Each selector as a condition on e, with its ancestors and siblings looked up.
_UP = "EXISTS (SELECT 1 FROM placed a WHERE a.page_id = e.page_id AND a.pos < e.pos AND a.post > e.pos AND {})"
_PARENT = "EXISTS (SELECT 1 FROM placed a WHERE a.page_id = e.page_id AND a.pos = e.parent AND {})"
_NEXT = "EXISTS (SELECT 1 FROM placed a WHERE a.page_id = e.page_id AND a.pos = e.before AND {})"
_AFTER = "EXISTS (SELECT 1 FROM placed a WHERE a.page_id = e.page_id AND a.parent = e.parent AND a.pos < e.pos AND {})"
SELECTED = {
    "nav > ul > li:nth-child(2) > a": "e.tag = 'a' AND EXISTS (SELECT 1 FROM placed l JOIN placed u ON u.page_id = l.page_id AND u.pos = l.parent JOIN placed v "
    "ON v.page_id = u.page_id AND v.pos = u.parent WHERE l.page_id = e.page_id AND l.pos = e.parent AND l.tag = 'li' AND l.nth = 2 AND u.tag = 'ul' AND v.tag = 'nav')",
    "h1 + p": "e.tag = 'p' AND " + _NEXT.format("a.tag = 'h1'"),
    "article p ~ p:last-child": "e.tag = 'p' AND e.nth = e.n AND " + _AFTER.format("a.tag = 'p'") + " AND " + _UP.format("a.tag = 'article'"),
    "article > p:not(:nth-child(2))": "e.tag = 'p' AND e.nth <> 2 AND " + _PARENT.format("a.tag = 'article'"),
    'li:nth-child(2n+3) a[href^="/"]': "e.tag = 'a' AND e.raw LIKE '% href=\"/%' AND " + _UP.format("a.tag = 'li' AND a.nth >= 3 AND a.nth % 2 = 1"),
    "body > div.ad, footer": "(e.tag = 'div' AND e.raw LIKE '%class=\"ad\"%' AND " + _PARENT.format("a.tag = 'body'") + ") OR e.tag = 'footer'",
    "p > b:only-child": "e.tag = 'b' AND e.n = 1 AND " + _PARENT.format("a.tag = 'p'"),
    "nav ~ article h1": "e.tag = 'h1' AND EXISTS (SELECT 1 FROM placed x JOIN placed v ON v.page_id = x.page_id AND v.parent = x.parent AND v.pos < x.pos "
    "WHERE x.page_id = e.page_id AND x.pos < e.pos AND x.post > e.pos AND x.tag = 'article' AND v.tag = 'nav')",
}
ORACLES["select_structure"] = f"""WITH {token_ctes(duck_fixture('structure_x'))}, {_ELEMENTS},
hit AS (SELECT page_id, min(pos) AS p FROM placed e JOIN src s USING (page_id) WHERE CASE s.selector
  {" ".join(f"WHEN '{sel}' THEN {cond}" for sel, cond in SELECTED.items())} END GROUP BY page_id)
SELECT s.page_id, s.selector, true AS supported, coalesce((SELECT string_agg(k.raw, '' ORDER BY k.pos) FROM kinds k JOIN els e ON e.page_id = h.page_id AND e.pos = h.p
  WHERE k.page_id = s.page_id AND k.pos > e.pos AND k.pos < e.post), '') AS content FROM src s LEFT JOIN hit h USING (page_id)"""

# -- results -----------------------------------------------------------------


def result_sql(judged: str, html_source: str = "done") -> str:
    """CTEs for results of `judged`: `res` with page_id, url, title, markdown, links, n_links."""
    blocks = block_ctes("SELECT page_id, url, html, site FROM done", base=True)
    links = link_ctes("SELECT page_id, url, html FROM done")
    # Both chains start from the same tokens; the second one is nested apart.
    return f"""{judged},
done AS (SELECT page_id, coalesce(final_url, url) AS url, html, regexp_extract(coalesce(final_url, url), '^[a-z]+://[^/]+') AS site FROM judged WHERE outcome = 'ok'),
made AS (WITH {blocks}, {KEEP}, {JOINED} SELECT page_id, markdown, article_title FROM pages_md),
linked AS (WITH {links} SELECT page_id, n_links, links FROM link_lists),
res AS (SELECT d.page_id, d.url, coalesce(m.article_title, {_TITLE.replace('html', 'd.html')}) AS title, coalesce(m.markdown, '') AS markdown,
  coalesce(l.links, '') AS links, coalesce(l.n_links, 0) AS n_links FROM done d LEFT JOIN made m USING (page_id) LEFT JOIN linked l USING (page_id))"""


RESULTS = result_sql(JUDGED.replace("src AS (", "crawl_src AS (", 1).replace("FROM src", "FROM crawl_src"))
ORACLES["page_results"] = f"WITH {RESULTS} SELECT page_id, url, title, markdown, links FROM res"
_PLAIN = result_sql("judged AS (SELECT page_id, url, url AS final_url, html, 'ok' AS outcome FROM pages)")
ORACLES["page_metrics"] = f"WITH {_PLAIN} SELECT page_id, url, length(markdown) AS markdown_length, n_links AS links_count FROM res"
ORACLES["stream_pages"] = ORACLES["page_metrics"]
ORACLES["run_summary"] = f"""WITH {RESULTS} SELECT category, outcome, http_status, count(*) AS n_rows, CAST(sum(length(r.markdown)) AS BIGINT) AS total_markdown_length,
  avg(length(r.markdown)) AS mean_markdown_length, CAST(sum(n_links) AS BIGINT) AS total_links FROM judged j LEFT JOIN res r USING (page_id) GROUP BY category, outcome, http_status"""
