"""Pages as interval-encoded trees, and CSS selectors over them.

One pass over a page's tags keeps the stack of open elements and numbers each
element with the tag it starts at, the tag it ends at, its depth and its
parent.  A descendant is then an interval inside another, a child one whose
parent is named, and a selector is answered with array functions on the row:
no shuffle, no Python.

How elements end (the HTML reading of missing end tags): void elements have
no content; an end tag closes the nearest open element of its name and all
inside it, and is ignored if there is none; ``p``, ``li``, ``dt``, ``dd``,
``option``, ``tr``, ``td``, ``th`` and table sections also end before the
start tags listed in ``IMPLIED_ENDS``; what is open at the end of the page
ends there.  Scripts, styles and comments are removed first.

Selectors: lists of ``tag``, ``*``, ``.class``, ``#id``, ``[attr]`` and
``[attr=value]`` (also ``~= ^= $= *=``) in any combination, joined by white
space (descendant) or ``>`` (child).  Tag and attribute names ignore case,
values do not.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.arrays import let, scan
from lectern.functions.html import BLOCK_TAGS, TAG, decode_entities, visible

# Fixed values of the HTML standard: elements without content, and which open
# elements a start tag ends, looked for up to the nearest boundary.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
_SECTIONS = ("tbody", "thead", "tfoot")
IMPLIED_ENDS = [
    # start tags, elements they end, boundary
    (("li",), ("li",), ("ul", "ol", "menu")),
    (("dt", "dd"), ("dt", "dd"), ("dl",)),
    (("option", "optgroup"), ("option",), ("select",)),
    (("td", "th"), ("td", "th"), ("table",)),
    (("tr",), ("tr", "td", "th"), ("table",)),
    (_SECTIONS, (*_SECTIONS, "tr", "td", "th"), ("table",)),
]
_P_BOUNDARY = ("table", "td", "th", "caption", "button", "object", "template", "html")
_NAME = r"^</?([a-zA-Z][^\s/>]*)"
_ATTRIBUTES = r"""[\s/]([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?"""
_STACK = "array<struct<name:string,start:int>>"
_ELEMENT = "struct<start:int,end:int,depth:int,parent:int,name:string>"


def _position(stack: Column, names: tuple[str, ...]) -> Column:
    """1-based place of the first entry with one of the names, 0 if none."""
    return F.coalesce(F.array_position(F.transform(stack, lambda e: e["name"].isin(*names)), True), F.lit(0)).cast("int")


def _ended_by(stack: Column, name: Column) -> Column:
    """How many open elements the start tag ``name`` ends."""
    def reach(ends: tuple[str, ...], boundary: tuple[str, ...]) -> Column:
        hits = F.filter(F.transform(stack, lambda e, i: F.struct(e["name"].alias("name"), (i + 1).alias("place"))),
                        lambda e: e["name"].isin(*ends, *boundary))
        # The last entry to be ended before a boundary stands in the way.
        return let(hits, lambda h: F.aggregate(
            h, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, e: F.when(a["on"] & e["name"].isin(*ends), F.struct(e["place"].alias("n"), F.lit(True).alias("on")))
            .otherwise(F.struct(a["n"].alias("n"), F.lit(False).alias("on"))), lambda a: a["n"]))

    out = F.lit(0)
    for starts, ends, boundary in IMPLIED_ENDS:
        # A list item or a cell ends at the first of its kind only: what lies further up holds it.
        found = reach(ends, boundary)
        out = F.when(name.isin(*starts), F.greatest(found, reach(("p",), _P_BOUNDARY) if starts[0] in ("li", "dt") else F.lit(0))).otherwise(out)
    plain = tuple(t for t in (*BLOCK_TAGS, "p") if t not in {s for starts, _, _ in IMPLIED_ENDS for s in starts})
    return F.when(name.isin(*plain), reach(("p",), _P_BOUNDARY)).otherwise(out)


def _step(state: Column, tag: Column) -> Column:
    stack, at = state["stack"], state["at"]
    name, closing = tag["name"], tag["closing"]
    ended = F.when(closing, F.coalesce(F.array_position(F.transform(stack, lambda e: e["name"]), name), F.lit(0)).cast("int")) \
        .when(name == "", F.lit(0)).otherwise(_ended_by(stack, name))

    def move(n: Column) -> Column:
        depth = F.size(stack)
        out = F.transform(F.slice(stack, F.lit(1), n), lambda e, i: F.struct(
            e["start"].alias("start"), at.alias("end"), (depth - i - 1).alias("depth"),
            F.coalesce(F.get(stack, i + 1)["start"], F.lit(-1)).alias("parent"), e["name"].alias("name")))
        rest = F.slice(stack, n + 1, F.greatest(depth - n, F.lit(0)))
        alone = tag["void"]
        own = F.array(F.struct(at.alias("start"), at.alias("end"), F.size(rest).alias("depth"),
                               F.coalesce(F.get(rest, F.lit(0))["start"], F.lit(-1)).alias("parent"), name.alias("name")))
        opens = ~closing & (name != "")
        out = F.when(opens & alone, F.concat(out, own)).otherwise(out)
        grown = F.concat(F.array(F.struct(name.alias("name"), at.alias("start"))), rest)
        return F.struct(F.when(opens & ~alone, grown).otherwise(rest).cast(_STACK).alias("stack"), (at + 1).alias("at"),
                        out.cast(f"array<{_ELEMENT}>").alias("ended"))

    return let(ended, move)


def page_tree(html: Column | str) -> Column:
    """struct(parts, elements): ``parts`` holds the page's text pieces and tags in
    turn (tag k is part 2k + 1); ``elements`` lists (start, end, depth, parent,
    name) by start, where start and end are tag numbers.  An element that the
    page leaves open ends at the number of tags."""
    def build(h: Column) -> Column:
        def tree(tags: Column) -> Column:
            described = F.transform(F.transform(tags, lambda t: F.struct(
                F.lower(F.regexp_extract(t, _NAME, 1)).alias("name"), t.startswith("</").alias("closing"))),
                lambda t: F.struct(t["name"].alias("name"), t["closing"].alias("closing"), t["name"].isin(*VOID_TAGS).alias("void")))
            zero = F.struct(F.array().cast(_STACK).alias("stack"), F.lit(0).alias("at"), F.array().cast(f"array<{_ELEMENT}>").alias("ended"))
            walked, read = scan(described, zero, _step, lambda s: s["ended"], F.array().cast(f"array<array<{_ELEMENT}>>"))

            def finish(w: Column) -> Column:
                stack = w["state"]["stack"]
                left = F.transform(stack, lambda e, i: F.struct(
                    e["start"].alias("start"), w["state"]["at"].alias("end"), (F.size(stack) - i - 1).alias("depth"),
                    F.coalesce(F.get(stack, i + 1)["start"], F.lit(-1)).alias("parent"), e["name"].alias("name")))
                pieces = F.split(h, TAG, -1)
                parts = F.flatten(F.transform(pieces, lambda p, i: F.array(p, F.coalesce(F.get(tags, i), F.lit("")))))
                elements = F.array_sort(F.concat(F.flatten(w["out"]), left.cast(f"array<{_ELEMENT}>")))
                return F.struct(parts.alias("parts"), elements.alias("elements"))

            return let(let(walked, read), finish)

        return let(F.regexp_extract_all(h, F.lit(TAG), F.lit(0)), tree)

    return let(visible(html), build)


def attribute(tag: Column, name: str) -> Column:
    """Decoded value of a start tag's attribute: '' without a value, NULL if absent.
    The first of several counts."""
    inner = F.regexp_replace(F.regexp_replace(tag, r"^<[^\s/>]*+", " "), r"/?>$", " ")
    names = F.transform(F.regexp_extract_all(inner, F.lit(_ATTRIBUTES), F.lit(1)), F.lower)
    values = F.regexp_extract_all(inner, F.lit(_ATTRIBUTES), F.lit(2))
    raw = F.get(values, F.array_position(names, F.lit(name.lower())).cast("int") - 1)
    bare = F.when(raw.startswith('"') | raw.startswith("'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
    return F.when(F.array_contains(names, name.lower()), decode_entities(F.coalesce(bare, F.lit(""))))


_SIMPLE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]""")


def _compound(text: str) -> Callable[[Column, Column], Column]:
    """Test of one compound selector as a function of (name, start tag)."""
    tests: list[Callable[[Column, Column], Column]] = []
    at = 0
    while at < len(text):
        found = _SIMPLE.match(text, at)
        if not found or (found[1] and at):
            raise ValueError(f"unsupported selector {text!r}")
        at = found.end()
        tag, cls, ident, attr, op, value = found.groups()
        value = value[1:-1] if value and value[0] in "\"'" else value
        if tag and tag != "*":
            tests.append(lambda n, t, tag=tag: n == tag.lower())
        elif cls:
            tests.append(lambda n, t, v=cls: F.array_contains(F.split(F.coalesce(attribute(t, "class"), F.lit("")), r"\s+"), v))
        elif ident:
            tests.append(lambda n, t, v=ident: attribute(t, "id").eqNullSafe(F.lit(v)))
        elif attr:
            def test(n, t, attr=attr, op=op, v=value):
                own = attribute(t, attr)
                if op is None:
                    return own.isNotNull()
                hit = {"=": own == F.lit(v), "~=": F.array_contains(F.split(own, r"\s+"), v), "^=": own.startswith(v),
                       "$=": own.endswith(v), "*=": own.contains(v)}[op]
                return F.coalesce(hit, F.lit(False)) & F.lit(bool(v) or op == "=")
            tests.append(test)
    # The name is tested first: attributes of other tags are not read.
    return lambda n, t: reduce(lambda a, b: a & b, [test(n, t) for test in tests], F.lit(True))


def parse_selector(selector: str) -> list[list[tuple[str, str]]]:
    """A list of alternatives, each a list of (combinator, compound); the first
    combinator of each is ''."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        tokens = re.findall(r"""\s*>\s*|\s+|(?:\[(?:"[^"]*"|'[^']*'|[^\]"'])*\]|[^\s>\[\]])+""", alternative.strip())
        chain: list[tuple[str, str]] = []
        combinator = ""
        for token in tokens:
            if not token.strip(" \t\n\r\f>"):
                combinator = ">" if ">" in token else " "
            else:
                _compound(token)
                chain.append((combinator, token))
                combinator = "?"
        if not chain or chain[0][0] or combinator != "?" or "".join(tokens) != alternative.strip():
            raise ValueError(f"unsupported selector {selector!r}")
        out.append(chain)
    return out


def _inside(outer: Column, candidates: Column) -> Column:
    """Candidates that lie inside one of ``outer``, by one sweep over both."""
    items = F.array_sort(F.concat(
        F.transform(candidates, lambda e: F.struct(e["start"].alias("at"), F.lit(0).alias("kind"), e["end"].alias("end"), e.alias("element"))),
        F.transform(outer, lambda e: F.struct(e["start"].alias("at"), F.lit(1).alias("kind"), e["end"].alias("end"), e.alias("element")))))
    zero = F.struct(F.lit(-1).alias("reach"), F.lit(False).alias("hit"))
    walked, read = scan(items, zero, lambda s, x: F.struct(
        F.when(x["kind"] == 1, F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"),
        ((x["kind"] == 0) & (x["at"] < s["reach"])).alias("hit")), lambda s: s["hit"], F.array().cast("array<boolean>"))
    flagged = let(walked, read)
    return F.transform(F.filter(F.arrays_zip(items.alias("x"), flagged["out"].alias("hit")), lambda z: z["hit"]), lambda z: z["x"]["element"])


def select(tree: Column, selector: str) -> Column:
    """Elements of a page tree that ``selector`` names, in document order."""
    chains = parse_selector(selector)
    return let(tree, lambda t: _select(t["parts"], t["elements"], chains))


def _select(parts: Column, elements: Column, chains: list[list[tuple[str, str]]]) -> Column:

    def named(test: Callable[[Column, Column], Column]) -> Callable[[Column], Column]:
        return lambda e: test(e["name"], F.get(parts, e["start"] * 2 + 1))

    def chain(steps: list[tuple[str, str]], found: Column) -> Column:
        if not steps:
            return found
        combinator, text = steps[0]
        candidates = F.filter(elements, named(_compound(text)))
        if combinator == ">":
            parents = F.transform(found, lambda e: e["start"])
            return let(let(parents, lambda p: F.filter(candidates, lambda e: F.array_contains(p, e["parent"]))), lambda f: chain(steps[1:], f))
        return let(_inside(found, candidates), lambda f: chain(steps[1:], f))

    def alternative(steps: list[tuple[str, str]]) -> Column:
        return let(F.filter(elements, named(_compound(steps[0][1]))), lambda f: chain(steps[1:], f))

    alternatives = [alternative(steps) for steps in chains]
    both = alternatives[0] if len(alternatives) == 1 else F.array_distinct(F.concat(*alternatives))
    return F.array_sort(both)


def inner_html(tree: Column, element: Column) -> Column:
    """Markup between an element's tags (its whole rest if the page leaves it open)."""
    return F.array_join(F.slice(tree["parts"], element["start"] * 2 + 3, F.greatest((element["end"] - element["start"]) * 2 - 1, F.lit(0))), "")


def start_tag(tree: Column, element: Column) -> Column:
    return F.get(tree["parts"], element["start"] * 2 + 1)


def first_inner_html(html: Column | str, selector: str) -> Column:
    """Inner HTML of the first element that ``selector`` names, else of ``<body>``,
    else the empty text; NULL for NULL."""
    page = F.col(html) if isinstance(html, str) else html
    found = let(page_tree(page), lambda t: let(
        F.coalesce(F.get(select(t, selector), F.lit(0)), F.get(select(t, "body"), F.lit(0))),
        lambda e: F.when(e.isNull(), F.lit("")).otherwise(inner_html(t, e))))
    return F.when(page.isNotNull(), found)


def selected(html: Column | str, selector: str, describe: Callable[[Column, Column], Column]) -> Column:
    """``describe(tree, element)`` of every element that ``selector`` names."""
    return let(page_tree(html), lambda t: F.transform(select(t, selector), lambda e: describe(t, e)))
