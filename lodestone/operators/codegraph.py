"""Nodes and edges of TypeScript and JavaScript files: classes, methods and functions with dotted scopes, imports, and calls inside a scope."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import chunking, graph
from lodestone.operators.batches import expanded
from lodestone.operators.codelexer import code_of

# The extensions that are read, those whose files may hold elements, words before a bracket that call nothing.
EXTENSIONS = ("ts", "tsx", "js", "jsx", "mts", "cts")
WITH_ELEMENTS = ("tsx", "js", "jsx")
NOT_CALLED = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "new", "constructor", "do", "else", "in", "of", "void", "delete", "yield", "throw", "case", "with")

NODE = {"path": "string", "name": "string", "kind": "string", "start_line": "long", "end_line": "long"}
EDGE = {"path": "string", "target": "string", "relation": "string"}

_NAME = r"([A-Za-z_$][\w$]*)"
_CLASS = re.compile(rf"\bclass\s+{_NAME}")
_BEFORE = re.compile(rf"(?P<function>\bfunction\s*\*?\s*)?(?<![\w$]){_NAME}\s*(?:<[^<>(){{}};]*>\s*)?(?=\()")
_BODY = re.compile(r"\s*(?::\s*[^{};=()]*[\w$>\]]\s*)?\{")
_BODYLESS = re.compile(r"\babstract\s[\w\s]*$")
_FROM = re.compile(r"\s*(?:.*\bfrom\s*)?", re.DOTALL)
#: Characters looked at before a name.
BEHIND = 80


def _closings(code: str) -> dict[int, int]:
    """Where each opening bracket is closed; those that aren't end with the file."""
    pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
    for found in re.finditer(r"[()\[\]{}]", code):
        mark = found[0]
        if mark not in pairs:
            stack.append((mark, found.start()))
        elif any(m == pairs[mark] for m, _ in stack[-3:]):
            while True:
                m, at = stack.pop()
                out[at] = found.start()
                if m == pairs[mark]:
                    break
    out.update((at, len(code)) for _, at in stack)
    return out


def _imported(text: str, code: str) -> list[str]:
    """What import statements name: the string after ``import``, or after its ``from``."""
    stops = [m for m in re.finditer(r"\bimport\b|;|'[^'\n]+'|\"[^\"\n]+\"", text) if m[0] != "import" or code.startswith("import", m.start())]
    pairs = ((m, after) for m, after in zip(stops, stops[1:], strict=False) if m[0] == "import" and after[0][0] in "'\"")
    return [after[0][1:-1] for m, after in pairs if _FROM.fullmatch(text, m.end(), after.start())]


def graph_of(text: str | None, jsx: bool = False) -> tuple[list[dict], list[dict]]:
    """Nodes and edges of one file.

    Comments, strings, regular expressions and the text of templates and elements are
    blanked first, so nothing in them counts but the expressions that they hold.
    A scope reaches to the bracket that closes its body.  Arrow functions and calls
    of ``require`` make neither nodes nor imports; constructors, ``super`` and ``new``
    are no calls.  Of equal paths the last stays.  A null text has none of either.
    """
    text = text or ""
    code = code_of(text, jsx)
    closed = _closings(code)
    starts = [0, *(m.end() for m in re.finditer("\n", code))]
    line = lambda at: bisect_right(starts, at)

    scopes, called = [], []
    ends = [m.start() for m in re.finditer(r"[{;]", code)]
    for m in _CLASS.finditer(code):
        head = bisect_right(ends, m.end() - 1)
        if head < len(ends) and code[ends[head]] == "{":
            scopes.append((m.start(), ends[head], closed[ends[head]], m[1], "class"))
    for m in _BEFORE.finditer(code):
        name, at = m[2], m.start(2)
        if m["function"] is None and name in NOT_CALLED:
            continue
        after = closed[m.end()] + 1
        before = code[max(0, at - BEHIND) : at].rstrip() if m["function"] is None else ""
        body = _BODY.match(code, after)
        if m["function"] is not None:
            if body:
                scopes.append((m.start(), body.end() - 1, closed.get(body.end() - 1, len(code)), name, "function"))
        elif before.endswith(".") or re.search(r"\bnew$", before):
            if before.endswith("."):
                called.append((at, name))
        elif body:
            scopes.append((at, body.end() - 1, closed.get(body.end() - 1, len(code)), name, "method"))
        elif _BODYLESS.search(code, max(code.rfind("\n", 0, at) + 1, at - BEHIND), at):
            scopes.append((at, after, after, name, "method"))
        else:
            called.append((at, name))

    nodes, edges, open_ = {}, {}, []
    called.sort()
    events = sorted([(s[0], 0, s) for s in scopes] + [(at, 1, name) for at, name in called], key=lambda e: e[:2])
    for at, what, value in events:
        while open_ and open_[-1][0] < at:
            open_.pop()
        path = open_[-1][1] if open_ else ""
        if what == 0:
            _, _, end, name, kind = value
            path = f"{path}.{name}" if path else name
            nodes[path] = {"path": path, "name": name, "kind": kind, "start_line": line(at), "end_line": line(min(end, len(code)))}
            open_.append((end, path))
        elif path:
            edges[path, value, "calls"] = {"path": path, "target": value, "relation": "calls"}
    for target in _imported(text, code):
        nodes.setdefault("file", {"path": "file", "name": "", "kind": "file", "start_line": 1, "end_line": len(starts)})
        edges["file", target, "imports"] = {"path": "file", "target": target, "relation": "imports"}
    return list(nodes.values()), list(edges.values())


def _nodes(text: str | None, extension: str) -> list[tuple]:
    return [tuple(x[c] for c in NODE) for x in graph_of(text, extension in WITH_ELEMENTS)[0]]


def _edges(text: str | None, extension: str) -> list[tuple]:
    return [tuple(x[c] for c in EDGE) for x in graph_of(text, extension in WITH_ELEMENTS)[1]]


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, symbol_name, symbol_path, symbol_type, file_path, start_line, end_line) and edges (source_node_id, target_node_name,
    target_node_id, relationship_type) of files (project_path, file_path, text) whose extension is read; targets are left to ``graph.resolve``.

    A file is a row of its own and needs no other: nothing is shuffled, and what it gives goes out in batches of a bounded size.
    """
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    rows = files.filter(extension.isin(*EXTENSIONS)).select("project_path", "file_path", "text", extension.alias("_ext"))
    ident = lambda path: F.sha2(F.concat_ws("|", "project_path", "file_path", path), 256)
    own = F.regexp_extract("file_path", r"([^/]*)$", 1)
    nodes = expanded(rows, 2, _nodes, NODE).select(ident("path").alias("node_id"), F.when(F.col("kind") == "file", own).otherwise(F.col("name")).alias("symbol_name"), F.col("path").alias("symbol_path"), F.col("kind").alias("symbol_type"), "file_path", "start_line", "end_line")
    edges = expanded(rows, 2, _edges, EDGE).select(ident("path").alias("source_node_id"), F.col("target").alias("target_node_name"), F.lit(None).cast("string").alias("target_node_id"), F.col("relation").alias("relationship_type"))
    return nodes, edges


def line_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of files in other languages, by their lines: symbols, the calls near below them, and what is imported."""
    extension = F.lower(F.regexp_extract("file_path", r"\.([^./]+)$", 1))
    rows = files.filter((chunking.route(F.col("file_path")) == "ast") & ~extension.isin(*EXTENSIONS)).select("file_path", "text", "project_path")
    found = chunking.symbols(rows, "file_path")
    path = F.concat_ws(".", F.nullif("scope", F.lit("")), "name")
    length = F.when(F.col("kind") == "class", chunking.CLASS_LINES).otherwise(chunking.FUNCTION_LINES)
    named = found.select("file_path", path.alias("symbol_path"), F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_type"), F.col("line").alias("start_line"), (F.col("line") + length).alias("end_line"))
    named = named.groupBy("file_path", "symbol_path").agg(F.max_by(F.struct("symbol_name", "symbol_type", "start_line", "end_line"), "start_line").alias("s")).select("file_path", "symbol_path", "s.*")
    projects = rows.select("file_path", "project_path")
    ident = lambda p: F.sha2(F.concat_ws("|", "project_path", "file_path", p), 256)
    nodes = named.join(projects, "file_path").select(ident("symbol_path").alias("node_id"), "symbol_name", "symbol_path", "symbol_type", "file_path", "start_line", "end_line")
    sites = chunking.calls(rows, "file_path")
    spans = named.select("file_path", F.col("symbol_path").alias("symbol"), F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    inside = graph.enclosing(spans, sites.select("file_path", "line").distinct()).filter("symbol is not null")
    calls = sites.join(inside, ["file_path", "line"]).select("file_path", F.col("symbol").alias("p"), "target", F.lit("calls").alias("relation"))
    imports = chunking.imports(rows, "file_path").select("file_path", F.lit("file").alias("p"), "target", F.lit("imports").alias("relation"))
    own = imports.select("file_path").distinct().join(projects, "file_path").select(ident(F.lit("file")).alias("node_id"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("symbol_name"), F.lit("file").alias("symbol_path"), F.lit("file").alias("symbol_type"), "file_path", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"))
    edges = calls.unionByName(imports).distinct().join(projects, "file_path").select(ident("p").alias("source_node_id"), F.col("target").alias("target_node_name"), F.lit(None).cast("string").alias("target_node_id"), F.col("relation").alias("relationship_type"))
    return nodes.unionByName(own), edges
