"""Pages as trees of intervals: outlines, texts of subtrees, selectors, excerpts.

An element is a row with its number in document order and that of the last element
inside it, so an element lies in another where its number lies in that one's interval.
The page's text, with white space squeezed, and its source are each one string, of
which an element's text and markup are slices.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.batches import expanded

# Void elements have no end; an outline goes to any depth unless it is asked for less; text of an element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAX_DEPTH, MAX_TEXT = sys.maxsize, 500

_FIELDS = {
    "node_id": "int", "parent_id": "long", "prev_id": "long", "last_id": "int", "depth": "int", "tag": "string", "element_id": "string", "class": "string", "text": "string",
    "attributes": "map<string,string>", "outer_start": "int", "inner_start": "int", "inner_end": "int", "outer_end": "int",
}
_OUTLINE = {c: _FIELDS[c] for c in ("node_id", "parent_id", "depth", "tag", "element_id", "class", "text")}


class _Node:
    __slots__ = ("attributes", "depth", "first", "inner_end", "inner_start", "last", "latest", "number", "outer_end", "outer_start", "parent", "prev", "stop", "tag")


class _Tree(HTMLParser):
    """The elements in document order; what isn't closed ends with its parent, or with the source."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.nodes, self.open = source, [], []
        self.text: list[str] = []
        self.length, self.latest = 0, None
        self.lines = [0]
        for m in re.finditer("\n", source):
            self.lines.append(m.end())
        self.feed(source)
        self.close()
        self._end(0, len(source), len(source))
        self.text = "".join(self.text)

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        x = _Node()
        x.number, x.parent, x.depth, x.tag, x.attributes = len(self.nodes), self.open[-1].number if self.open else None, len(self.open), tag, dict(attrs)
        x.prev = self.open[-1].latest if self.open else self.latest
        if self.open:
            self.open[-1].latest = x.number
        else:
            self.latest = x.number
        x.latest, x.first = None, self.length
        x.outer_start = self._at()
        x.inner_start = x.outer_start + len(self.get_starttag_text())
        self.nodes.append(x)
        self.open.append(x)
        if tag in VOID:
            self._end(len(self.open) - 1, x.inner_start, x.inner_start)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                at = self._at()
                close = self.source.find(">", at)
                self._end(i, at, close + 1 if close >= 0 else len(self.source))
                return

    def _end(self, first: int, inner: int, outer: int) -> None:
        """Ends the open elements from the first on; all but that one before the closing tag."""
        for k, x in enumerate(self.open[first:]):
            x.stop, x.last, x.inner_end = self.length, len(self.nodes) - 1, inner
            x.outer_end = outer if k == 0 else inner
        del self.open[first:]

    def handle_data(self, data):
        if not self.open:
            return
        squeezed = re.sub(r"\s+", " ", data)
        if squeezed.startswith(" ") and self.text and self.text[-1].endswith(" "):
            squeezed = squeezed[1:]
        if squeezed:
            self.text.append(squeezed)
            self.length += len(squeezed)

    def preview(self, x: _Node, most: int) -> str:
        """The text inside an element, without white space around it."""
        return self.text[x.first : min(x.stop, x.first + most + 2)].strip()[:most]

    def row(self, x: _Node, most: int) -> tuple:
        own = x.attributes
        return (x.number, x.parent, x.prev, x.last, x.depth, x.tag, own.get("id"), own.get("class"), self.preview(x, most), {k: v or "" for k, v in own.items()}, x.outer_start, x.inner_start, x.inner_end, x.outer_end)


def _outlined(html: str | None, max_depth: int, max_text: int, max_nodes: int) -> Iterator[tuple]:
    """The rows of an outline one by one: the texts of elements in one another are together many times the page."""
    tree = _Tree(html or "")
    found = (x for x in tree.nodes if x.depth <= max_depth)
    for x in islice(found, max_nodes or None):
        yield (x.number, x.parent, x.depth, x.tag, x.attributes.get("id"), x.attributes.get("class"), tree.preview(x, max_text))


def outline(html: str | None, max_depth: int = MAX_DEPTH, max_text: int = MAX_TEXT, max_nodes: int = 0) -> list[tuple]:
    """(node_id, parent_id, depth, tag, element_id, class, text): the first max_nodes elements (0: all) down to max_depth, in document order, each with the text inside it."""
    return list(_outlined(html, max_depth, max_text, max_nodes))


def outlines(pages: DataFrame, key: str = "page_id", html: str = "html", max_depth: int = MAX_DEPTH, max_nodes: int = 0) -> DataFrame:
    """One row per element of each page; a page is one task's work, no shuffle."""
    return expanded(pages.select(key, html), 1, lambda source: _outlined(source, max_depth, MAX_TEXT, max_nodes), _OUTLINE)


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """All elements of each page, with the interval of the elements inside, the sibling before, attributes, and where they stand in the source (characters)."""

    def rows(source: str | None) -> Iterator[tuple]:
        tree = _Tree(source or "")
        return (tree.row(x, MAX_TEXT) for x in tree.nodes)

    return expanded(pages.select(key, html), 1, rows, _FIELDS)


# --- selectors ---------------------------------------------------------------

_PART = re.compile(r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<quoted>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\]""")
_ALTERNATIVE = re.compile(r"""(?:[^,\[]|\[(?:"[^"]*"|'[^']*'|[^\]"'])*\])+""")
_JOINS = re.compile(r"\s*([>+~])\s*|\s+")


def parse_selector(selector: str) -> list[list[tuple[str, list[dict]]]]:
    """Alternatives, each a list of (what joins it to the one before, parts of the compound)."""
    out = []
    if _ALTERNATIVE.sub("", selector).strip(", "):
        raise ValueError(f"not a selector: {selector!r}")
    for alternative in _ALTERNATIVE.findall(selector):
        steps, i, joint, alternative = [], 0, " ", alternative.strip()
        while i < len(alternative):
            parts = []
            while m := _PART.match(alternative, i):
                parts.append({k: v for k, v in m.groupdict().items() if v is not None})
                i = m.end()
            if not parts:
                raise ValueError(f"not a selector: {selector!r}")
            steps.append((joint, parts))
            if i < len(alternative):
                m = _JOINS.match(alternative, i)
                if not m or m.end() == len(alternative):
                    raise ValueError(f"not a selector: {selector!r}")
                joint, i = m[1] or " ", m.end()
        if not steps:
            raise ValueError(f"not a selector: {selector!r}")
        out.append(steps)
    if not out:
        raise ValueError(f"not a selector: {selector!r}")
    return out


def _fits(parts: list[dict]) -> Column:
    test = F.lit(True)
    for p in parts:
        if "tag" in p:
            one = F.lit(True) if p["tag"] == "*" else F.col("tag") == p["tag"].lower()
        elif "id" in p:
            one = F.col("element_id") == p["id"]
        elif "class" in p:
            one = F.array_contains(F.split(F.coalesce("class", F.lit("")), r"\s+"), p["class"])
        else:
            own, value = F.col("attributes")[p["name"].lower()], p.get("quoted", p.get("single", p.get("bare", "")))
            word = F.array_contains(F.split(own, r"\s+"), value)
            one = {None: own.isNotNull(), "=": own == value, "^=": own.startswith(value), "$=": own.endswith(value), "*=": own.contains(value), "~=": word, "|=": (own == value) | own.startswith(f"{value}-")}[p.get("op")]
            if value == "" and p.get("op") in ("^=", "$=", "*=", "~="):
                one = F.lit(False)
        test = test & F.coalesce(one, F.lit(False))
    return test


def select(nodes: DataFrame, selector: str, key: str = "page_id") -> DataFrame:
    """The elements that a selector names: tags, #ids, .classes, [attributes], inside (space), children (>), siblings (+, ~), alternatives (,).

    Whether an element lies in one that was found is decided by a running maximum of the ends of those intervals in
    document order, a window over a page; parents and siblings are joined by their numbers.
    """
    out = None
    for steps in parse_selector(selector):
        found = None
        for joint, parts in steps:
            fits = nodes.filter(_fits(parts))
            if found is None:
                found = fits
            elif joint == " ":
                ends = found.select(key, "node_id", F.col("last_id").alias("_end"), F.lit(True).alias("_outer")).unionByName(fits.select(key, "node_id", F.lit(None).cast("int").alias("_end"), F.lit(False).alias("_outer")))
                reach = F.max("_end").over(Window.partitionBy(key).orderBy("node_id").rangeBetween(Window.unboundedPreceding, -1))
                inside = ends.withColumn("_reach", reach).filter("NOT _outer AND _reach >= node_id").select(key, "node_id")
                found = fits.join(inside, [key, "node_id"], "left_semi")
            elif joint == ">":
                found = fits.join(found.select(key, F.col("node_id").cast("long").alias("parent_id")), [key, "parent_id"], "left_semi")
            elif joint == "+":
                found = fits.join(found.select(key, F.col("node_id").cast("long").alias("prev_id")), [key, "prev_id"], "left_semi")
            else:
                first = found.groupBy(key, F.coalesce("parent_id", F.lit(-1)).alias("_parent")).agg(F.min("node_id").alias("_first"))
                found = fits.withColumn("_parent", F.coalesce("parent_id", F.lit(-1))).join(first, [key, "_parent"]).filter("_first < node_id")
            found = found.select(*nodes.columns)
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates([key, "node_id"])


def excerpts(pages: DataFrame, selector: str, outer: bool = True, max_chars: int = 0, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, excerpt) of each page (distinct keys): the source of the first element that the selector names, with or without its own tags, cut to max_chars (0: whole); null if there is none."""
    found = select(elements(pages, key, html), selector, key)
    first = found.groupBy(key).agg(F.min(F.struct("node_id", "outer_start", "inner_start", "inner_end", "outer_end")).alias("_f"))
    start, end = (F.col("_f.outer_start"), F.col("_f.outer_end")) if outer else (F.col("_f.inner_start"), F.col("_f.inner_end"))
    size = F.least(end - start, F.lit(max_chars)) if max_chars else end - start
    return pages.select(key, html).join(first, key, "left").select(key, F.when(F.col("_f").isNotNull(), F.substring(F.col(html), start + 1, size)).alias("excerpt"))


def pruned(nodes: DataFrame, max_depth: int, drop: tuple[str, ...] = ("script", "style")) -> DataFrame:
    """A tree's rows down to a depth, without the named elements."""
    return nodes.filter(nodes["depth"] <= max_depth).filter(~nodes["tag"].isin(*drop))
