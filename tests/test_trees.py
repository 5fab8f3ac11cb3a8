"""Pages as trees: outlines, selectors and excerpts against plain recursion."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest

from lodestone.functions import html

TAGS, CLASSES = ("div", "p", "b", "ul", "li"), ("x", "y", "z")


def _page(rng, depth=0):
    """(source, tree): a tree is [tag, attributes, children], a child a text or a tree."""
    tag, attrs = rng.choice(TAGS), {}
    if rng.random() < 0.4:
        attrs["class"] = " ".join(rng.sample(CLASSES, rng.randrange(1, 3)))
    if rng.random() < 0.15:
        attrs["id"] = rng.choice("qr")
    if rng.random() < 0.2:
        attrs["data-k"] = rng.choice(["en", "en-us", "of two words"])
    children = []
    for _ in range(rng.randrange(4) if depth < 5 else 0):
        children.append(rng.choice(["one", " two ", "th&amp;ree\n", "  "]) if rng.random() < 0.4 else _page(rng, depth + 1))
    return [tag, attrs, children]


def _source(tree):
    if isinstance(tree, str):
        return tree
    tag, attrs, children = tree
    return f"<{tag}{''.join(f' {k}="{v}"' for k, v in attrs.items())}>{''.join(map(_source, children))}</{tag}>"


def _walk(tree, above=(), before=()):
    """(tree, ancestors, siblings before) in document order."""
    yield tree, above, before
    seen = ()
    for child in tree[2]:
        if not isinstance(child, str):
            yield from _walk(child, (*above, tree), seen)
            seen = (*seen, child)


def _text(tree):
    return tree.replace("&amp;", "&") if isinstance(tree, str) else "".join(map(_text, tree[2]))


def _simple(tree, part):
    tag, attrs, _ = tree
    if m := re.fullmatch(r"\[([\w-]+)(?:(.?=)['\"]?([^'\"\]]*)['\"]?)?\]", part):
        own, op, value = attrs.get(m[1]), m[2], m[3]
        return own is not None and {None: True, "=": own == value, "^=": own.startswith(value or ""), "~=": value in own.split(), "|=": own == value or own.startswith(f"{value}-")}[op]
    if part[0] == "#":
        return attrs.get("id") == part[1:]
    if part[0] == ".":
        return part[1:] in attrs.get("class", "").split()
    return part in ("*", tag)


def _matches(entry, steps):
    """Whether an element with its ancestors and siblings fits (parts, joint, parts, ...) read from its end."""
    tree, above, before = entry
    *rest, last = steps
    if not all(_simple(tree, p) for p in last):
        return False
    if not rest:
        return True
    *rest, joint = rest
    parents = [(a, above[:i], tuple(c for c in (above[i - 1][2] if i else []) if not isinstance(c, str) and _before(c, a, above[i - 1][2]))) for i, a in enumerate(above)]
    siblings = [(s, above, before[:i]) for i, s in enumerate(before)]
    options = {" ": parents, ">": parents[-1:], "+": siblings[-1:], "~": siblings}[joint]
    return any(_matches(o, rest) for o in options)


def _before(child, other, children):
    for c in children:
        if c is other:
            return False
        if c is child:
            return True
    return False


SELECTORS = {
    "div": [[["div"]]],
    "div p.x": [[["div"], " ", ["p", ".x"]]],
    "ul > li b": [[["ul"], ">", ["li"], " ", ["b"]]],
    ".x.y , #q": [[[".x", ".y"]], [["#q"]]],
    "p + .z": [[["p"], "+", [".z"]]],
    "b ~ [data-k]": [[["b"], "~", ["[data-k]"]]],
    "* > [data-k|=en]": [[["*"], ">", ["[data-k|=en]"]]],
    '[data-k~="two"] *': [[["[data-k~=two]"], " ", ["*"]]],
    "div div div": [[["div"], " ", ["div"], " ", ["div"]]],
}


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(4)
    return [["div", {}, [_page(rng) for _ in range(rng.randrange(1, 5))]] for _ in range(60)]


@pytest.fixture(scope="module")
def pages(spark, trees):
    return spark.createDataFrame([(k, _source(x)) for k, x in enumerate(trees)] + [(1000, None), (1001, ""), (1002, "only text")], "page_id long, html string").repartition(3)


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors(pages, trees, selector):
    want = set()
    for k, tree in enumerate(trees):
        for n, entry in enumerate(_walk(tree)):
            if any(_matches(entry, steps) for steps in SELECTORS[selector]):
                want.add((k, n))
    got = html.select(html.elements(pages), selector).collect()
    assert {(r.page_id, r.node_id) for r in got} == want and len(got) == len(want) and want
    first = {k: min(n for p, n in want if p == k) for k in {p for p, _ in want}}
    found = {r.page_id: r.excerpt for r in html.excerpts(pages, selector).collect()}
    for k, tree in enumerate(trees):
        assert found[k] == (_source([e[0] for e in _walk(tree)][first[k]]) if k in first else None)
    assert found[1000] is found[1001] is found[1002] is None


def test_outline_pruned_and_counts(pages, trees):
    rows = {(r.page_id, r.node_id): r for r in html.outlines(pages).collect()}
    want, kept, counts = {}, set(), {}
    for k, tree in enumerate(trees):
        for n, (x, above, _) in enumerate(_walk(tree)):
            want[k, n] = (x[0], len(above), x[1].get("id"), x[1].get("class"), " ".join(_text(x).split())[: html.MAX_TEXT])
            counts[k] = n + 1
            if len(above) <= 4 and x[0] != "b":
                kept.add((k, n))
    assert {k: (r.tag, r.depth, r.element_id, r["class"], r.text) for k, r in rows.items()} == want
    assert {(r.page_id, r.node_id) for r in html.pruned(html.outlines(pages), 4, drop=("b",)).collect()} == kept
    few = html.outlines(pages, max_nodes=3).groupBy("page_id").count().collect()
    assert {r.page_id: r["count"] for r in few} == {k: min(3, n) for k, n in counts.items()}
    spans = html.elements(pages).collect()
    assert all(r.node_id <= r.last_id < counts[r.page_id] for r in spans)


class _Loop(HTMLParser):
    """(tag, depth) of each start tag, by a plain stack."""

    def __init__(self, text):
        super().__init__()
        self.seen, self.stack = [], []
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, len(self.stack)))
        if tag not in html.VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass


def test_queries_on_the_given_pages(spark):
    from lodestone import catalog

    folder = "/root/testdata/sf0.001"
    loops = {r.page_id: _Loop(r.html or "").seen for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    run = lambda name: catalog.queries()[name](spark, folder).collect()
    assert {(r.page_id, r.node_id): (r.tag, r.depth) for r in run("html_outline")} == {(k, n): x for k, seen in loops.items() for n, x in enumerate(seen) if x[1] <= html.MAX_DEPTH}
    assert {(r.page_id, r.node_id) for r in run("html_pruned")} == {(k, n) for k, seen in loops.items() for n, (tag, d) in enumerate(seen) if d <= 4 and tag not in ("script", "style")}
    assert {r.page_id: (r.nodes, r.depth) for r in run("a16_dom_nodes")} == {k: (sum(d <= html.MAX_DEPTH for _, d in seen), max(d for _, d in seen if d <= html.MAX_DEPTH)) for k, seen in loops.items()}


def test_elements_at_any_depth(spark, tmp_path):
    """Paragraphs that aren't closed lie in one another: none is left out of an outline or of the counts, unless a depth is asked for."""
    from lodestone import catalog

    sources = {1: "<p>a" * 40, 2: "<div>" * 11 + "<b>c</b><br>" * 3, 3: "<i>x</i>" * 5, 4: "<ul><li>" * 5000}
    spark.createDataFrame(list(sources.items()), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name, folder: catalog.queries()[name](spark, str(folder)).collect()
    assert {r.page_id: (r.nodes, r.depth) for r in run("a16_dom_nodes", tmp_path)} == {1: (40, 39), 2: (17, 11), 3: (5, 0), 4: (10000, 9999)}
    assert {(r.page_id, r.node_id): (r.tag, r.depth) for r in run("html_outline", tmp_path)} == {(k, n): x for k, source in sources.items() for n, x in enumerate(_Loop(source).seen)}
    assert [x[2] for x in html.outline(sources[1], max_depth=10)] == list(range(11))
    given = "/root/testdata/sf0.001"
    loops = {r.page_id: _Loop(r.html or "").seen for r in spark.read.parquet(f"{given}/pages.parquet").collect()}
    got = {r.page_id: (r.nodes, r.depth) for r in run("a16_dom_nodes", given)}
    assert got == {k: (len(seen), max(d for _, d in seen)) for k, seen in loops.items()} and max(d for _, d in got.values()) > 10


@pytest.mark.parametrize("selector", ["", ",", "p >", "> p", "p..x", "[", "p[", "a:hover", "p,"])
def test_what_is_no_selector(selector):
    if selector == "p,":
        assert html.parse_selector(selector) == html.parse_selector("p")
    else:
        with pytest.raises(ValueError, match="not a selector"):
            html.parse_selector(selector)
