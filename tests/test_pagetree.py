"""Page trees and selectors: golden pages, and random ones against Python's
``html.parser``."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from lectern.functions import html as H
from lectern.functions import pagetree as PT
from lectern.functions.arrays import scan


def column(spark, pages, expression):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, x string").select("i", expression(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


PAGE = ('<body><div class="top"><p>t</p></div><div id="main" class="wide entry-content x"><p>1</p><div><p>2</p><div><p>3</p></div></div><p>4</p></div>'
        '<p>5</p><article><p>6</p><article><p>7</p></article><p>8</p></article><p>9</p></body>')
FIRST = {".entry-content": "1234", "div#main > div": "23", "div": "t", ".entry": "t123456789", "p.entry-content": "t123456789",
         "body > article article": "7", "section, article": "678", "[class~=entry-content] div > div": "3"}


def test_first_match_or_body(spark):
    tree = spark.createDataFrame([(PAGE,)], "x string").select(PT.page_tree("x").alias("t"))
    tree = spark.createDataFrame(tree.collect(), tree.schema)
    found = tree.select(*[PT.inner_html(F.col("t"), F.get(PT.select(F.col("t"), f"{s}, body"), F.lit(1 if n < 9 else 0))).alias(str(i))
                          for i, (s, n) in enumerate((s, len(n)) for s, n in FIRST.items())]).first()
    assert {s: "".join(c for c in re.sub("<[^>]*>", "", f)) for s, f in zip(FIRST, found)} == FIRST
    (first,) = column(spark, [PAGE], lambda x: H.stripped_paragraph_texts(PT.first_inner_html(x, "div.entry-content")))
    assert first == ["1", "2", "3", "4"]


def test_odd_pages(spark):
    long_tag = "<body><div " + "data-a='b' " * 90_000 + 'class="a"><p>y</p></div><p>z</p></body>'
    pages = ["<body><div class='a'><p>1</p><div><p>2</p>", "<p>no body</p>", None, "<body><div class=a><p>x</p></div></body>", "",
             "<div data-x=1 class=\"b a\">q</div>", "<div title='class=\"a\"'>no</div><DIV CLASS=a>yes</DIV>", long_tag, "</div></p><div class=a>s</p></div>t",
             "<div class='a&amp;b'>no</div><div class=a>in", "<script><div class=a>no</div></script><!--<div class=a>--><div class='x\n\ta'>m</div>"]
    assert column(spark, pages, lambda x: PT.first_inner_html(x, ".a")) == [
        "<p>1</p><div><p>2</p>", "", None, "<p>x</p>", "", "q", "yes", "<p>y</p>", "s</p>", "in", "m"]


def test_deep_and_wide_pages(spark):
    deep, wide = "<div>" * 400 + "x" + "</div>" * 400, "<ul>" + "<li><a href=#>y</a>" * 20_000 + "</ul>"
    (a, b) = column(spark, [deep, wide], lambda x: F.size(PT.select(PT.page_tree(x), "div div, ul > li a")))
    assert (a, b) == (399, 20_000)


@pytest.mark.parametrize("page,expected", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["ul 0-7 0", "li 1-2 1", "li 2-6 1", "ul 3-5 2", "li 4-5 3", "li 6-7 1"]),
    ("<p>a<p>b<div>c</div>d", ["p 0-1 0", "p 1-2 0", "div 2-3 0"]),
    ("<table><tr><td>1<td>2<tr><th>3</table>e", ["table 0-6 0", "tr 1-4 1", "td 2-3 2", "td 3-4 2", "tr 4-6 1", "th 5-6 2"]),
    ("<b><i>x</b>y</i>", ["b 0-2 0", "i 1-2 1"]), ("<br><img src=a>t<hr/>", ["br 0-0 0", "img 1-1 0", "hr 2-2 0"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["dl 0-4 0", "dt 1-2 1", "dd 2-3 1", "dt 3-4 1"]), ("</x>a<!doctype html><?php ?>", []),
    ("<p><table><tr><td><p>x</table>", ["p 0-1 0", "table 1-5 0", "tr 2-5 1", "td 3-5 2", "p 4-5 3"]),
    ("<select><option>a<option>b</select>", ["select 0-3 0", "option 1-2 1", "option 2-3 1"])])
def test_where_elements_end(spark, page, expected):
    (tree,) = column(spark, [page], PT.page_tree)
    assert [f"{e.name} {e.start}-{e.end} {e.depth}" for e in tree.elements] == expected
    assert "".join(tree.parts) == page.replace("<!--", "")


class Nodes(HTMLParser):
    """(name, depth, parent, text) of every element of a well-formed page."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.nodes = [], []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.nodes.append([tag, len(self.stack), self.stack[-1] if self.stack else None, "", dict(attrs)])
        if tag not in PT.VOID_TAGS:
            self.stack.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        for i in self.stack:
            self.nodes[i][3] += data


def _random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(0, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 6:
            out += rng.choice(["text ", "1 < 2 ", "a&amp;b ", "é "])
        elif kind < 0.5:
            out += rng.choice(["<br>", "<img alt='>'>", "<hr/>"])
        else:
            tag = rng.choice(["div", "span", "section", "b", "em"])
            attrs = rng.choice(["", " class=a", " class='b a'", ' id="x>y" class="b"', " data-k", " CLASS=\"A\" data-k='&lt;1'"])
            out += f"<{tag}{attrs}>{_random_page(rng, depth + 1)}</{tag}>"
    return out


def test_random_pages_equal_the_library(spark):
    rng = random.Random(7)
    pages = ["<main>" + _random_page(rng) + "</main>" for _ in range(150)]
    trees = column(spark, pages, lambda x: PT.selected(x, "*", lambda t, e: F.struct(
        e["name"].alias("name"), e["depth"].alias("depth"), H.plain_text(PT.inner_html(t, e)).alias("text"),
        PT.attribute(PT.start_tag(t, e), "class").alias("cls"), PT.attribute(PT.start_tag(t, e), "data-k").alias("k"))))
    inside = column(spark, pages, lambda x: F.size(PT.select(PT.page_tree(x), ".a div > span, section .b")))
    for page, tree, hits in zip(pages, trees, inside):
        nodes = Nodes(page).nodes
        assert [(e.name, e.depth, e.text) for e in tree] == [(n, d, t) for n, d, _, t, _ in nodes]
        assert [(e.cls, e.k) for e in tree] == [(a.get("class"), "" if "data-k" in a and a["data-k"] is None else a.get("data-k")) for *_, a in nodes]

        def up(i):
            while (i := nodes[i][2]) is not None:
                yield i

        def has(i, cls):
            return cls in (nodes[i][4].get("class") or "").split()

        expected = sum(
            (n[0] == "span" and n[2] is not None and nodes[n[2]][0] == "div" and any(has(j, "a") for j in up(n[2])))
            or (has(i, "b") and any(nodes[j][0] == "section" for j in up(i))) for i, n in enumerate(nodes))
        assert hits == expected


@pytest.mark.parametrize("selector", ["", "div >", "> p", "a b,", "p:first", "a + b", "div..x", "[a", "p$"])
def test_unknown_selectors_are_refused(selector):
    with pytest.raises(ValueError):
        PT.parse_selector(selector)


def test_scan_keeps_every_state(spark):
    walked, read = scan(F.col("a"), F.lit(0), lambda s, x: s + x, lambda s: s, F.array().cast("array<int>"))
    for n in (0, 1, 127, 128, 129, 1000):
        df = spark.createDataFrame([(list(range(n)),)], "a array<int>")
        assert df.select(walked.alias("w")).select(read(F.col("w")).alias("r")).first().r.out == [i * (i + 1) // 2 for i in range(n)]
