"""Test inputs derived from the given tables, one SQL text for both engines.

Every fixture is a projection over whole tables, so it grows with them. The few
spellings in which the engines differ are filled in per dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def bytes(self, text: str) -> str:
        return f"encode({text}, 'UTF-8')" if self.spark else f"encode({text})"

    def list(self, text: str, order: str) -> str:
        """Concatenation of `text` in the order of integer `order`."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {text} AS t))), x -> x.t), '')"
        return f"string_agg({text}, '' ORDER BY {order})"

    def rank(self, part: str, order: str) -> str:
        return f"row_number() OVER (PARTITION BY {part} ORDER BY {order})"


def _quad(d: Dialect, n: str) -> str:
    """A dotted quad from an integer column; about half are private."""
    second = (
        f"CASE WHEN {n} % 8 = 5 THEN 10 + {n} % 30 WHEN {n} % 8 = 6 AND {n} % 3 <> 0 THEN 168 "
        f"WHEN {n} % 8 = 4 AND {n} % 3 <> 0 THEN 254 ELSE {d.div(n, 7)} % 256 END"
    )
    first = (
        f"CASE {n} % 8 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 93 WHEN 3 THEN 127 "
        f"WHEN 4 THEN 169 WHEN 5 THEN 172 WHEN 6 THEN 192 ELSE 203 END"
    )
    return (
        f"CAST({first} AS STRING) || '.' || CAST({second} AS STRING) || '.' || "
        f"CAST({d.div(n, 3)} % 256 AS STRING) || '.' || CAST({n} % 251 AS STRING)"
    )


def crawl_x(d: Dialect) -> str:
    return f"""
SELECT page_id,
  CASE page_id % 23 WHEN 3 THEN 'not-a-url' WHEN 4 THEN 'file:///etc/passwd'
    WHEN 5 THEN 'http://127.0.0.1/admin' WHEN 6 THEN 'http://10.0.0.' || CAST(page_id % 200 AS STRING) || '/x'
    WHEN 7 THEN 'ftp://example.com/a' WHEN 8 THEN url || '/file.PDF' WHEN 9 THEN '  '
    ELSE url END AS url,
  CASE WHEN page_id % 19 = 2 THEN 'http://192.168.1.' || CAST(page_id % 200 AS STRING) || '/in'
    WHEN page_id % 19 = 3 THEN 'https://example.com/moved/' || CAST(page_id AS STRING)
    ELSE CASE page_id % 23 WHEN 3 THEN 'not-a-url' WHEN 4 THEN 'file:///etc/passwd'
    WHEN 5 THEN 'http://127.0.0.1/admin' WHEN 6 THEN 'http://10.0.0.' || CAST(page_id % 200 AS STRING) || '/x'
    WHEN 7 THEN 'ftp://example.com/a' WHEN 8 THEN url || '/file.PDF' WHEN 9 THEN '  '
    ELSE url END END AS final_url,
  CASE page_id % 13 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 200 END AS status,
  CASE page_id % 17 WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN 'application/pdf'
    WHEN 3 THEN '{DOCX}' WHEN 4 THEN 'application/octet-stream' WHEN 5 THEN 'Image/PNG; q=1'
    WHEN 6 THEN NULL WHEN 7 THEN 'application/XHTML+xml' WHEN 8 THEN 'Application/Octet-Stream;x=y'
    WHEN 9 THEN 'application/json' WHEN 10 THEN '' WHEN 11 THEN 'application/pdf; v=1.7'
    ELSE 'text/html' END AS content_type,
  html,
  CASE WHEN page_id % 17 IN (2, 3, 4, 8, 11) THEN
    {d.bytes("CASE WHEN page_id % 2 = 0 THEN '%PDF-1.4 ' || html ELSE html END")} END AS body,
  CASE WHEN page_id % 29 = 7 THEN 'connect ECONNREFUSED' END AS fetch_error
FROM {{pages}}"""


def addr_x(d: Dialect) -> str:
    k = f"{d.div('event_id', 16)} % 10"
    e = "CAST(event_id AS STRING)"
    return f"""
SELECT event_id AS id,
  CASE WHEN event_id % 16 = 9 THEN CASE {k} WHEN 0 THEN '::1' WHEN 1 THEN 'fe80::' || {e}
    WHEN 2 THEN 'FC00::' || {e} WHEN 3 THEN '2001:db8::' || {e} WHEN 4 THEN '::ffff:127.0.0.1'
    WHEN 5 THEN '::ffff:172.20.1.1' WHEN 6 THEN '::FFFF:10.1.2.3' WHEN 7 THEN '::ffff:8.8.8.8'
    WHEN 8 THEN 'fd12:' || {e} || '::1' ELSE 'fec0::1' END
  WHEN event_id % 97 = 5 THEN '300.1.2.' || {e}
  WHEN event_id % 97 = 6 THEN 'host' || {e}
  ELSE {_quad(d, "event_id")} END AS addr
FROM {{events}}"""


def url_x(d: Dialect) -> str:
    e = "CAST(event_id AS STRING)"
    b = "CAST(event_id % 256 AS STRING)"
    return f"""
SELECT event_id AS id, CASE event_id % 21
  WHEN 0 THEN 'http://' || {_quad(d, "event_id")} || '/secret'
  WHEN 1 THEN 'HTTP://User:pw@' || {_quad(d, "event_id")} || ':8080/a/../b?q=' || {e}
  WHEN 2 THEN 'ftp://files.example.com/' || {e}
  WHEN 3 THEN 'file:///etc/' || {e}
  WHEN 4 THEN 'gopher://example.org/' || {e}
  WHEN 5 THEN 'data:text/plain,' || {e}
  WHEN 6 THEN 'not a url ' || {e}
  WHEN 7 THEN 'http://127.' || {b} || '/'
  WHEN 8 THEN 'http://0x7F.0.0.' || {b} || '/x.tar.GZ'
  WHEN 9 THEN 'http://0177.1.' || {e} || ':80/'
  WHEN 10 THEN 'http://[::1]:8080/' || {e}
  WHEN 11 THEN 'https://[fe80::' || CAST(event_id % 9999 AS STRING) || ']/'
  WHEN 12 THEN 'https://Sub.Example.COM:443/Path%20x/./y/../z/file' || {e} || '.PDF?token=a.b#frag.c'
  WHEN 13 THEN 'https://a_b.example.com/' || {e}
  WHEN 14 THEN '  http://example.com/pad' || {e} || '  '
  WHEN 15 THEN 'http://example.com:99999/' || {e}
  WHEN 16 THEN 'http://' || CAST(2130706433 + event_id * 4099 AS STRING) || '/'
  WHEN 17 THEN 'https://example.com/für/' || {e} || ' x?ü=1#é'
  WHEN 18 THEN CASE WHEN event_id % 2 = 0 THEN '' END
  WHEN 19 THEN 'http://300.1.1.' || {b} || '/'
  ELSE 'http://localhost/' || {e} || '.docx' END AS url
FROM {{events}}
UNION ALL SELECT 1000000000 + page_id AS id, url FROM {{pages}}
UNION ALL SELECT 2000000000 + page_id AS id, CASE page_id % 6
  WHEN 0 THEN 'http://0xfffffffffffffffffffff/' WHEN 1 THEN 'http://07777777777777777777777777777/'
  WHEN 2 THEN 'http://99999999999999999999999999/' WHEN 3 THEN 'http://0x00000000000000000000007f.1/'
  WHEN 4 THEN 'http://00000000000000000000000000177.1/' ELSE 'http://1.2.0xffffffffffffffffffff/' END AS url FROM {{pages}}"""


def host_x(d: Dialect) -> str:
    p = "CAST(page_id AS STRING)"
    return f"""
SELECT page_id AS id, CASE page_id % 12
  WHEN 0 THEN 'bücher' || {p} || '.example' WHEN 1 THEN 'пример' || {p} || '.испытание'
  WHEN 2 THEN '例え' || {p} || '。テスト' WHEN 3 THEN 'faß' || {p} || '.de' WHEN 4 THEN 'münchen-ost' || {p} || '.ÄRZTE.example'
  WHEN 5 THEN '１２７.0.0.' || CAST(page_id % 256 AS STRING) WHEN 6 THEN 'ⓔxample' || {p} || '．org'
  WHEN 7 THEN '😀' || {p} || '😀é.com' WHEN 8 THEN repeat('ü', CAST(page_id % 70 AS INT)) || '.org'
  WHEN 9 THEN {p} || 'مثال.إختبار' WHEN 10 THEN 'xn--bcher-kva' || {p} || '.example'
  ELSE split_part(split_part(url, '/', 3), ':', 1) END AS host FROM {{pages}}
UNION ALL SELECT 1000000000 + doc_id AS id, translate(substr(replace(lower(text), ' ', ''), 1, CAST(5 + doc_id % 50 AS INT)), 'aeiouy', 'äéïøüж') || '.net' AS host
FROM {{documents}} WHERE text IS NOT NULL"""


def allowed_host(d: Dialect) -> str:
    return """
SELECT DISTINCT upper(split_part(split_part(url, '/', 3), ':', 1)) AS host FROM {pages} WHERE page_id % 10 = 0
UNION ALL SELECT 'LocalHost' AS host FROM {region} WHERE r_regionkey = 0
UNION ALL SELECT '127.0.0.' || CAST(n_nationkey AS STRING) AS host FROM {nation}"""


def cidr_x(d: Dialect) -> str:
    s = "s_suppkey"
    return f"""
SELECT CASE {s} % 9 WHEN 0 THEN 'not-a-cidr' || CAST({s} AS STRING)
  WHEN 1 THEN '10.' || CAST({s} % 256 AS STRING) || '.0.0/33'
  WHEN 2 THEN '300.0.0.0/8' WHEN 3 THEN '10.' || CAST({s} % 256 AS STRING) || '.7.9/16'
  WHEN 4 THEN '192.168.' || CAST({s} % 256 AS STRING) || '.0/24'
  WHEN 5 THEN '172.' || CAST(16 + {s} % 16 AS STRING) || '.0.0/' || CAST(12 + {s} % 20 AS STRING)
  WHEN 6 THEN '127.' || CAST({s} % 256 AS STRING) || '.1/24'
  WHEN 7 THEN ' 169.254.' || CAST({s} % 256 AS STRING) || '.128/25 '
  ELSE '10.96.0.0/' || CAST({s} % 40 AS STRING) END AS cidr
FROM {{supplier}}"""


def dns_x(d: Dialect) -> str:
    """Up to three addresses for the host of each page."""
    host = "lower(split_part(split_part(url, '/', 3), ':', 1))"
    return f"""
SELECT {host} AS host, '93.184.216.' || CAST(page_id % 256 AS STRING) AS addr FROM {{pages}} WHERE page_id % 4 <> 0
UNION ALL SELECT upper({host}) AS host, {_quad(d, "page_id")} AS addr FROM {{pages}} WHERE page_id % 5 = 1
UNION ALL SELECT {host} AS host, CASE WHEN page_id % 2 = 0 THEN 'fd00::1' ELSE '2001:db8::1' END AS addr
  FROM {{pages}} WHERE page_id % 7 = 2"""


def href_x(d: Dialect) -> str:
    e = "CAST(event_id AS STRING)"
    return f"""
SELECT event_id AS id,
  CASE event_id % 3 WHEN 0 THEN 'http://Shop.Example.com/a/b/c.html?x=1#top' WHEN 1 THEN 'https://shop.example.com:8443/'
    ELSE 'http://news.example.org' END AS base,
  CASE event_id % 22
    WHEN 0 THEN 'http://shop.example.com/abs/' || {e} WHEN 1 THEN 'https://SHOP.example.com:444/p?a=1&b=' || {e}
    WHEN 2 THEN 'http://other.example.net/' || {e} WHEN 3 THEN '//shop.example.com/p/' || {e}
    WHEN 4 THEN '?q=' || {e} WHEN 5 THEN '#f' || {e} WHEN 6 THEN '../a/./b' || {e} WHEN 7 THEN 'mailto:x@example.com'
    WHEN 8 THEN 'JavaScript:go(' || {e} || ')' WHEN 9 THEN ' data:text/plain,x' WHEN 10 THEN 'tel:' || {e}
    WHEN 11 THEN '  ' WHEN 12 THEN '/' || {e} || '/für.html' WHEN 13 THEN 'rel ative/' || {e}
    WHEN 14 THEN '/../../x/../y' || {e} || '/.' WHEN 15 THEN 'VBScript:x' WHEN 16 THEN 'http://news.example.org:80'
    WHEN 17 THEN 'sub/..' WHEN 18 THEN '//news.example.org/ü?ü'
    WHEN 20 THEN 'http://0xfffffffffffffffffffff/' || {e} WHEN 21 THEN 'http://shop.example.com/&#x11111111111111111111;' || {e} ELSE '/the,' || {e} || '.' END AS href,
  CASE event_id % 4 WHEN 1 THEN '' WHEN 2 THEN 'nofollow' WHEN 3 THEN 'noopener me' END AS rel
FROM {{events}}"""


def anchor_x(d: Dialect) -> str:
    """Pages of anchors, one page per hundred events."""
    a = (
        "CASE id % 5 WHEN 0 THEN '<p>x <a name=\"n\">no link</a> <!-- <a href=\"/no\">no</a> -->' "
        "WHEN 1 THEN '<script>var a=\"<a href=/no>\";</script>' ELSE ' text ' END || "
        "'<a' || CASE WHEN rel IS NULL THEN ' title=\"a > b href=x\"' ELSE ' rel=\"' || rel || '\"' END || "
        "' href=' || CASE WHEN id % 2 = 0 THEN '\"' || replace(href, '&', '&amp;') || '\"' ELSE '''' || href || '''' END || '>' || "
        "CASE id % 3 WHEN 0 THEN '  <b>Go</b> &amp; see ' ELSE 'T&copy;' END || CAST(id AS STRING) || "
        "CASE WHEN id % 7 = 0 THEN '' ELSE '</a>' END"
    )
    return f"""
SELECT page_id, CASE page_id % 2 WHEN 0 THEN 'http://shop.example.com/a/b/c.html' ELSE 'http://news.example.org/' END AS url,
  {d.list("a", "id")} AS html
FROM (SELECT {d.div('id', 100)} AS page_id, id, {a} AS a FROM ({href_x(d)}) h) x GROUP BY page_id"""


def html_list_x(d: Dialect) -> str:
    """One page per customer: orders as a nested, numbered or task list."""
    o = "CAST(o_orderkey AS STRING)"
    item = (
        "CASE o_custkey % 4 "
        f"WHEN 0 THEN '<li>order ' || {o} || '<ul><li>' || o_orderpriority || '</li><li><p>one ' || {o} || '</p><p>two</p></li></ul>' || CASE WHEN o_orderkey % 2 = 0 THEN '</li>' ELSE '' END "
        f"WHEN 1 THEN '<li>' || o_orderstatus || ' ' || {o} || '<ol start=\"' || CAST(o_orderkey % 7 AS STRING) || '\"><li>a</li><li>b ' || {o} || '</ol></li>' "
        f"WHEN 2 THEN '<li><input type=\"checkbox\"' || CASE WHEN o_orderstatus = 'F' THEN ' checked' ELSE '' END || '> order ' || {o} || '</li>' "
        f"ELSE '<li><b>' || o_orderpriority || '</b></li><li> </li>' END"
    )
    head = "CASE o_custkey % 4 WHEN 1 THEN '<ol start=3>' ELSE '<ul>' END"
    tail = "CASE o_custkey % 4 WHEN 1 THEN '</ol>' ELSE '</ul></ul>' END"
    return f"""
SELECT o_custkey AS page_id, '<h2>C' || CAST(o_custkey AS STRING) || '</h2>' || min({head}) || {d.list(item, "o_orderkey")} ||
  min({tail}) || 'after <ul><li>last</li></ul>' AS html
FROM {{orders}} GROUP BY o_custkey"""


def html_table_x(d: Dialect) -> str:
    """One page per part brand and size: parts as tables, inline or laid out."""
    row = (
        "'<tr><td>' || CAST(p_partkey AS STRING) || '</td><td>' || CASE p_partkey % 4 WHEN 0 THEN p_name || ' | x' "
        "WHEN 1 THEN '<b>' || p_name WHEN 2 THEN p_name || '<br>' || p_type ELSE '<i> </i>' END || '</td>' || "
        "CASE WHEN p_partkey % 5 = 0 THEN '<td><a href=\"/p\">' || CAST(p_size AS STRING) || '</a></td>' ELSE '' END || '</tr>'"
    )
    head = (
        "CASE g % 3 WHEN 0 THEN '<table><caption>Parts</caption><thead><tr><th>key</th><th>name</th></tr></thead><tbody>' "
        "WHEN 1 THEN '<table>' ELSE '<table><tr><td><p>lay</p></td></tr>' END"
    )
    tail = "CASE g % 3 WHEN 0 THEN '</tbody></table>' ELSE '</table>' END"
    return f"""
SELECT g AS page_id, min('<p>before</p>' || {head}) || {d.list(row, "p_partkey")} || min({tail} || 'after') AS html
FROM (SELECT {d.div('p_partkey', 8)} AS g, * FROM {{part}}) p GROUP BY g"""


def html_mix_x(d: Dialect) -> str:
    i = "CAST(doc_id AS STRING)"
    return f"""
SELECT doc_id AS page_id, '<html><head><title>Doc ' || {i} || '</title></head><body><h' || CAST(1 + doc_id % 6 AS STRING) || '>Doc &amp; ' || {i} ||
  '<br>sub</h' || CAST(1 + doc_id % 6 AS STRING) || '>' || CASE doc_id % 16
  WHEN 0 THEN '<pre class="language-txt">' || t || '</pre>'
  WHEN 1 THEN '<pre><code class="x language-py">  a = [1] * 2  ' || t || '</code></pre>'
  WHEN 2 THEN '<p>see <code>x_y * ' || {i} || '</code> and <code></code>' || t || '</p>'
  WHEN 3 THEN '<p><em> ' || t || ' </em>end <i></i><strong><b>bold</b></strong></p>'
  WHEN 4 THEN '<p>so <del>gone ' || {i} || '</del> <s>old</s> <b>open ' || t || '<p>next</p>'
  WHEN 5 THEN '<blockquote><p>' || t || '</p><p>two<br>lines</p><blockquote>deep</blockquote></blockquote>out'
  WHEN 6 THEN '<p><a href="/a?b=1&amp;c=' || {i} || '" title="say ' || {i} || '">' || t || '</a> <a href="x"><img src="/i.png" alt="pic" title="T"></a></p>'
  WHEN 7 THEN '<p>' || t || '<img alt="none"><img src=y.gif></p><hr>tail<hr/>'
  WHEN 8 THEN '<h2>' || t || '</h2><p>x</p>'
  WHEN 9 THEN '<p># no</p><p>- no</p><p>+ no</p><p>1. no</p><p>&gt; no</p><p>== no</p><p>~~~ no</p><p>a*b_c[d]`e' || t || '</p>'
  WHEN 10 THEN '<!-- c --><style>p{{{{}}}}</style><script>if (a<b) x("<p>")</script><p>' || t || '</p><!-- open'
  WHEN 11 THEN '<p>&#233;&#x1F600; &copy;&nbsp;&middot; &lt;b&gt; &unknown; &#0; &#128; &#x11111111111111111111; &#99999999999999999999; &#x00000000000000000041; ' || t || '</p>'
  WHEN 12 THEN '<div>' || t || '<br> - a<br>2. b<br></div>'
  WHEN 13 THEN '<p>  lead ' || replace(t, ' ', '  ') || '  </p>'
  WHEN 14 THEN '<ul><li>' || t || '<blockquote>q</blockquote></ul>'
  ELSE '<p>x < y ' || t || ' <b>bo<i>th</b> it</i></p>' END || '</body></html>' AS html
FROM (SELECT doc_id, replace(replace(replace(text, '<', '('), '>', ')'), '&', '+') AS t FROM {{documents}}) q"""


def unspaced_x(d: Dialect) -> str:
    """Pages in scripts that put no spaces between words, beside Latin ones."""
    return """
SELECT -1 - page_id AS page_id, '<nav><a href="/a">首页</a> <a href="/b">新闻</a></nav><p>' || repeat('磨坊在两条河的交汇处。', CAST(page_id % 9 AS INT)) ||
  '</p><p>a few plain words ' || CAST(page_id AS STRING) || '</p><p>' || repeat('水車とカタカナ x ', CAST(page_id % 4 AS INT)) || repeat('ภาษาไทย', CAST(page_id % 3 AS INT)) ||
  '</p>' AS html FROM {pages}"""


def select_x(d: Dialect) -> str:
    return """
SELECT page_id, html, CASE page_id % 14 WHEN 0 THEN 'h1' WHEN 1 THEN 'div.ad' WHEN 2 THEN '.ad' WHEN 3 THEN 'nav a'
  WHEN 4 THEN '#none' WHEN 5 THEN 'article' WHEN 6 THEN 'nav ul' WHEN 7 THEN 'article h1'
  WHEN 8 THEN 'h9 , article' WHEN 9 THEN 'div.ad.none' WHEN 10 THEN 'div[class="ad"]' WHEN 11 THEN 'nav ul a' WHEN 12 THEN 'body nav li' ELSE 'ul > li' END AS selector
FROM {pages}"""


# Selectors that look at the tree around an element.
STRUCTURES = (
    "nav > ul > li:nth-child(2) > a", "h1 + p", "article p ~ p:last-child", "article > p:not(:nth-child(2))", 'li:nth-child(2n+3) a[href^="/"]',
    "body > div.ad, footer", "p > b:only-child", "nav ~ article h1",
)


def structure_x(d: Dialect) -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STRUCTURES))
    return f"SELECT page_id, html, CASE page_id % {len(STRUCTURES)} {cases} END AS selector FROM {{pages}}"


def file_x(d: Dialect) -> str:
    i = "CAST(doc_id AS STRING)"
    return f"""
SELECT path, {"octet_length(content)" if d.spark else "octet_length(content)"} AS length, content FROM (
  SELECT '/in/' || CAST(doc_id % 10 AS STRING) || '/doc' || {i} || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF'
    WHEN 2 THEN '.docx' WHEN 3 THEN '.txt' WHEN 4 THEN '' ELSE '.v2.DocX' END AS path,
  {d.bytes("CASE WHEN doc_id % 5 < 3 THEN '%PDF-1.7 ' || text ELSE text END")} AS content
  FROM {{documents}}) f"""


def flag_x(d: Dialect) -> str:
    e = "CAST(event_id AS STRING)"
    return f"""
SELECT event_id AS id,
  CASE event_id % 7 WHEN 0 THEN 'true' WHEN 1 THEN ' 1 ' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' WHEN 4 THEN NULL
    WHEN 5 THEN '' ELSE ' true' END AS flag,
  CASE event_id % 5 WHEN 0 THEN 'a, b ,,c' || {e} WHEN 1 THEN ' ' WHEN 2 THEN NULL WHEN 3 THEN {e} || ',' ELSE ',x y, ,z ' END AS list
FROM {{events}}"""


def request_log(d: Dialect) -> str:
    return "SELECT event_id, user_id AS key, ts FROM {events}"


TABLES = ("pages", "events", "documents", "orders", "part", "supplier", "nation", "region")
FIXTURES = {
    f.__name__: f
    for f in (
        crawl_x, addr_x, url_x, host_x, allowed_host, cidr_x, dns_x, href_x, anchor_x, html_list_x,
        html_table_x, html_mix_x, unspaced_x, select_x, structure_x, file_x, flag_x, request_log,
    )
}


def spark_fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = FIXTURES[name](Dialect(spark=True))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def duck_fixture(name: str) -> str:
    return FIXTURES[name](Dialect(spark=False)).format(**{t: t for t in TABLES})
