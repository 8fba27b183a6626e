from pyspark.sql import functions as F

from pagemill.api import select_content, to_markdown
from pagemill.functions.urls import url_parts

PAGE = r"""<html><head><title>T</title><noscript>no</noscript>stray</head><body><h1>Hello <em>w</em></h1>
<p>para * one<br>- two<br></p><ul><li>a<ul><li>b</li><li><p>c1</p><p>c2</p></li></ul></li>
<li><input type=checkbox checked> done</li></ul><ol start=3><li>x</li><li>y</li></ol>
<blockquote><p>q1</p><p>q2</p></blockquote><pre class="language-py"><code>a = [1]
 b*2</code></pre><hr><table><tr><th>A</th><th>B|b</th></tr><tr><td>1</td><td><b>x</td></tr></table>
<table><tr><td><p>lay</p></td><td>out</td></tr></table><table><tr><td>p</td></tr></table>
<p><code>x*y</code> <a href="/p?a=1" title='t "q"'>link <b>b</b></a> <img src=i.png alt=pic> <del>gone</del> <b></b>
<strong> sp </strong>x</p><script>var t="</p>"</script><p># h</p><p>1. y &lt;b&gt;</p></body></html>"""

WANT = r"""# Hello _w_

para \* one  
\- two

-   a
    -   b
    -   c1

        c2
-   [x] done
3.  x
4.  y

> q1
>
> q2

```py
a = [1]
 b*2
```

* * *

| A | B\|b |
| --- | --- |
| 1 | **x** |

lay

out

|  |
| --- |
| p |

`x*y` [link **b**](/p?a=1 "t \"q\"") ![pic](i.png) ~~gone~~ **sp** x

\# h

1\. y <b>"""


def markdown_of(spark, *pages, **options):
    rows = spark.createDataFrame([(i, "http://h.org/d/p.html", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    return [r.markdown for r in to_markdown(rows, **options).orderBy("page_id").collect()]


def test_every_rule_on_one_page(spark):
    assert markdown_of(spark, PAGE, main_content=False) == [WANT]


def test_loose_markup_does_not_leak(spark):
    got = markdown_of(
        spark,
        "<p><b>open<br><p>next</b> x</ul></blockquote><ul><li>a</ul>",
        "a < b and c > d <i>x",
        None,
        "<!-- <p>no</p>",
        "<p>\x10odd\x1e</p>",
        main_content=False,
    )
    assert got == ["**open**\n\nnext x\n\n-   a", "a < b and c > d _x_", "", "", "odd"]


def test_links_become_absolute(spark):
    got = markdown_of(spark, "<p><a href='../x y'>t</a></p>", base=url_parts(F.col("url")), main_content=False)
    assert got == ["[t](http://h.org/x%20y)"]


def test_main_content_and_fallback(spark):
    words = " ".join(["word"] * 30)
    nav = "<ul>" + "<li><a href=/a>one</a></li>" * 3 + "</ul>"
    got = markdown_of(spark, f"<body>{nav}<h1>Head</h1><p>{words}</p>{nav}", f"<body>{nav}")
    assert got[0] == f"# Head\n\n{words}"
    assert got[1] == "\n".join(["-   [one](/a)"] * 3)


def test_selectors(spark):
    page = (
        '<div class="x">0</div><nav id="n"><div class="a b"><p>1<div>in</div></p></div><a href=/>A</a></nav>'
        "<a>out</a><br><section class=s><a>late</a></section>"
    )
    cases = {
        "div.b": "<p>1<div>in</div></p>",
        ".x": "0",
        "#n": '<div class="a b"><p>1<div>in</div></p></div><a href=/>A</a>',
        "nav a": "A",
        "#n a": "A",
        ".s a": "late",
        "section.s a": "late",
        "nav#n": '<div class="a b"><p>1<div>in</div></p></div><a href=/>A</a>',
        "#none": "",
        "br": "",
        ".b.a": "<p>1<div>in</div></p>",
        "div.a.c": "",
        "[class=x]": "0",
        "a[href='/']": "A",
        "a[href=x]": "",
        "h1, .s a , p": "1<div>in</div>",
        "nav div p": "1<div>in</div>",
        "section div p": "",
        "#n .a.b p": "1<div>in</div>",
        "a > b": "",
        "a b c d": "",
        "a b c d e f g": "",
        "a:hover": "",
        "": "",
    }
    rows = spark.createDataFrame([(i, page, s) for i, s in enumerate(cases)], "page_id long, html string, selector string")
    found = select_content(rows).collect()
    assert {r.selector: r.content for r in found} == cases
    assert {r.selector for r in found if not r.supported} == {"a b c d e f g", "a:hover", ""}


def test_long_page(spark):
    """Thousands of blocks, deep lists and hostile markup stay linear."""
    pages = ["<p>x" * 20000, "<ul><li>y" * 300, "<" * 50000, "<a href='" * 3000, "<table><tr><td>c" + "<tr><td>d" * 3000 + "</table>"]
    got = markdown_of(spark, *pages, main_content=False)
    assert got[0].count("x") == 20000 and got[1].count("y") == 300 and got[4].count("| d |") == 3000
