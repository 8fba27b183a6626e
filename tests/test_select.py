"""Elements and selectors against a tree built by hand, on random pages."""

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.api import select_content
from pagemill.functions.markup import VOID_TAGS
from pagemill.operators.elements import IMPLIED_ENDS, PAGE_END, elements
from pagemill.operators.select import MAX_STEPS, is_supported


class Tree(HTMLParser):
    """Elements as dicts, by a stack: what HTML's rules for left out end tags give for these pages."""

    def __init__(self, text):
        super().__init__(convert_charrefs=False)
        self.text, self.all, self.stack = text, [], []
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(text)
        self.close()
        while self.stack:
            self.stack.pop()["post"] = None

    def place(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self.place()
        while self.stack and any(self.stack[-1]["tag"] in own and tag in ends for own, ends in IMPLIED_ENDS):
            self.stack.pop()["post"] = at
        raw = self.get_starttag_text()
        e = {"tag": tag, "attrs": dict(attrs), "at": at, "size": len(raw), "parent": self.stack[-1] if self.stack else None, "post": at + len(raw)}
        self.all.append(e)
        if tag not in VOID_TAGS:
            self.stack.append(e)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.stack):
            while True:
                e = self.stack.pop()
                e["post"] = self.place()
                if e["tag"] == tag:
                    break


def family(tree, e):
    return [x for x in tree.all if x["parent"] is e["parent"]]


def fits(tree, e, compound):
    nots = re.findall(r":not\(((?:[^()]|\([^()]*\))*)\)", compound)
    if any(fits(tree, e, n.strip()) for n in nots):
        return False
    rest = re.sub(r":not\((?:[^()]|\([^()]*\))*\)", "", compound)
    for name, how, value in re.findall(r"\[(\w[\w-]*)([~|^$*]?=)?['\"]?([^'\"\]]*)['\"]?\]", rest):
        have = e["attrs"].get(name)
        if have is None:
            return False
        tests = {
            "": True, "=": have == value, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-"),
            "^=": have.startswith(value), "$=": have.endswith(value), "*=": value in have,
        }
        if not tests[how]:
            return False
    rest = re.sub(r"\[[^\]]*\]", "", rest)
    brothers = family(tree, e)
    nth = next(i for i, x in enumerate(brothers, 1) if x is e)
    last = len(brothers) + 1 - nth
    for p in re.findall(r":(nth-child\([^)]*\)|first-child|last-child|only-child)", rest):
        if p == "first-child" and nth != 1 or p == "last-child" and last != 1 or p == "only-child" and (nth, last) != (1, 1):
            return False
        if p.startswith("nth"):
            inner = p[10:-1].replace(" ", "").replace("odd", "2n+1").replace("even", "2n")
            m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", inner)
            a = 0 if m[1] is None else int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
            b = int(m[2] or 0)
            if not any(a * k + b == nth for k in range(200)):
                return False
    rest = re.sub(r":(nth-child\([^)]*\)|[a-z-]+)", "", rest)
    tag = re.match(r"[\w-]*", rest)[0]
    return (
        (not tag or e["tag"] == tag)
        and all(e["attrs"].get("id") == i for i in re.findall(r"#([\w-]+)", rest))
        and all(c in (e["attrs"].get("class") or "").split() for c in re.findall(r"\.([\w-]+)", rest))
    )


def matches(tree, e, parts):
    """parts: compound, combinator, compound ... of a chain."""
    if not fits(tree, e, parts[-1]):
        return False
    if len(parts) == 1:
        return True
    how, rest = parts[-2], parts[:-2]
    if how == ">":
        return e["parent"] is not None and matches(tree, e["parent"], rest)
    if how in "+~":
        earlier = [x for x in family(tree, e) if x["at"] < e["at"]]
        return any(matches(tree, x, rest) for x in (earlier[-1:] if how == "+" else earlier))
    up = e["parent"]
    while up is not None:
        if matches(tree, up, rest):
            return True
        up = up["parent"]
    return False


def chosen(text, chains):
    tree = Tree(text)
    for e in tree.all:
        if any(matches(tree, e, parts) for parts in chains):
            return "" if e["tag"] in VOID_TAGS else text[e["at"] + e["size"] : e["post"]]
    return ""


def random_page(rng, size=40):
    """Nested elements; end tags that HTML lets one leave out are left out at times."""
    out = []

    def attrs():
        made = ""
        if rng.random() < 0.4:
            made += f' class="{" ".join(rng.sample(["a", "b", "c-d"], rng.randint(1, 2)))}"'
        if rng.random() < 0.2:
            made += f" id={rng.choice(['x', 'y'])}"
        if rng.random() < 0.2:
            made += f" data-k='{rng.choice(['one two', 'en-GB', 'one'])}'"
        return made

    def grow(tags, depth):
        for _ in range(rng.randint(1, 4)):
            if len(out) > size * 4:
                return
            tag = rng.choice(tags)
            if tag == "br":
                out.append(f"<br{attrs()}>")
                continue
            out.append(f"<{tag}{attrs()}>")
            out.append(f"t{len(out)}")
            inner = {"ul": ["li"], "li": ["b", "ul", "br", "a"], "p": ["b", "a", "br"], "b": ["a", "br"], "a": ["b"]}.get(
                tag, ["div", "p", "ul", "p", "section"]
            )
            if depth < 6 and rng.random() < 0.8:
                grow(inner, depth + 1)
            if tag in ("li", "p") and rng.random() < 0.4:
                continue
            if rng.random() < 0.05:
                out.append("</i>")
            out.append(f"</{tag}>")

    grow(["div", "p", "ul", "section"], 0)
    return "".join(out)


COMPOUNDS = [
    "div", "p", "ul", "li", "b", "a", "br", "section", ".a", ".b", "#x", "*", "p.a", "li:first-child", "li:last-child", "li:nth-child(2)",
    ":nth-child(2n+1)", "p:nth-child(even)", ":nth-child(-n+2)", "a:only-child", "p:not(.a)", ":not(p)", "li:not(:nth-child(2))", "[id]",
    "[data-k~='two']", "[data-k|=en]", "[data-k^='on']", "[data-k$=o]", "[data-k*='e t']", ".c-d", "[data-k='one two']", "*:not(#x):not(.b)",
]


def random_selector(rng):
    chains, texts = [], []
    for _ in range(rng.choice([1, 1, 1, 2])):
        parts = [rng.choice(COMPOUNDS)]
        text = parts[0]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            how, nxt = rng.choice([" ", ">", ">", "+", "~"]), rng.choice(COMPOUNDS)
            parts += [how, nxt]
            text += (how if rng.random() < 0.3 or how == " " else f" {how} ") + nxt
        chains.append(parts)
        texts.append(text)
    return rng.choice([",", ", ", " , "]).join(texts), chains


def test_selectors_against_a_tree(spark):
    rng = random.Random(4)
    rows, wanted = [], {}
    for i in range(1500):
        text = random_page(rng)
        selector, chains = random_selector(rng)
        rows.append((i, text, selector))
        wanted[i] = chosen(text, chains)
    df = spark.createDataFrame(rows, "page_id long, html string, selector string")
    got = {r.page_id: r for r in select_content(df).collect()}
    assert len(got) == len(rows) and all(r.supported for r in got.values())
    wrong = [(rows[i][2], rows[i][1], got[i].content, wanted[i]) for i in wanted if got[i].content != wanted[i]]
    assert not wrong, (len(wrong), wrong[0])
    assert sum(bool(w) for w in wanted.values()) > 300


def test_intervals_and_families(spark):
    rng = random.Random(9)
    texts = [random_page(rng, 80) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")
    got = {}
    for r in elements(df).collect():
        got.setdefault(r.page_id, []).append((r.at, r.tag, None if r.post == PAGE_END else r.post, r.parent, r.nth, r.nth_last))
    for i, text in enumerate(texts):
        tree = Tree(text)
        rows = []
        for e in tree.all:
            brothers = family(tree, e)
            nth = brothers.index(e) + 1
            rows.append((e["at"], e["tag"], e["post"], e["parent"]["at"] if e["parent"] else -1, nth, len(brothers) + 1 - nth))
        assert sorted(got[i]) == rows


ODD = {
    "<p>x": ("p", "x"), "": ("p", ""), "no tags": ("*", ""), "</p></div>": ("p", ""), "<b><i>x</b>y</i>": ("i", "x"),
    "<p><b>x<p>y</div>": ("p + p", "y</div>"), "<a href='x>y'>z</a>": ("a[href='x>y']", "z"), "<br>": ("br", ""),
    "<div><div><div>deep</div></div></div>": ("div > div > div", "deep"), "<ul><li>1<ul><li>2</ul><li>3</ul>": ("ul > li ~ li", "3"),
    "<table><tr><td>a<td>b<tr><td>c</table>": ("tr + tr > td", "c"), "<p a=1><p A='2'>q": ("p[a='2']", "q"),
}


def test_odd_pages(spark):
    df = spark.createDataFrame([(i, h, s) for i, (h, (s, _)) in enumerate(ODD.items())] + [(99, None, "p"), (98, "<p>x", None)], "page_id long, html string, selector string")
    got = {r.page_id: (r.content, r.supported) for r in select_content(df).collect()}
    assert [got[i][0] for i in range(len(ODD))] == [c for _, c in ODD.values()]
    assert got[99] == ("", True) and got[98] == ("", False)


@pytest.mark.parametrize("bad", ["p:hover", "p >", "> p", "p,,q", "p::before", "a:not(b c)", "", "[x", "p" + " p" * MAX_STEPS, ":nth-child(x)"])
def test_other_selectors_are_not_supported(spark, bad):
    df = spark.createDataFrame([(1, "<p>x</p>", bad)], "page_id long, html string, selector string")
    row = select_content(df).first()
    assert (row.content, row.supported) == ("", False)
    assert df.select(is_supported(F.lit("p" + " p" * (MAX_STEPS - 1))).alias("s")).first().s


def test_pages_move_once_and_tokens_are_not_copied(spark):
    df = spark.createDataFrame([(1, "<p>x</p>", "p")], "page_id long, html string, selector string")
    plan = select_content(df)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(page_id[^\n]*", plan)) <= 4
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    deep = "<div>" * 4000 + "x" + "</div>" * 4000
    rows = spark.createDataFrame([(1, deep, "div > div div + p, div:not(.a) > div > div")], "page_id long, html string, selector string")
    assert select_content(rows).first().content.count("<div>") == 3997
