"""The code graph of TypeScript and JavaScript, PHP kinds over several lines, services and routes of parsed files."""

from __future__ import annotations

import time

import pytest

from pyspark.sql import functions as F

from lodestone.operators import catalogs, chunking, codegraph
from lodestone.operators import graph as g
from lodestone.operators.codegraph import graph_of
from lodestone.operators.codelexer import code_of

SHOP = """import { a, b } from "./lib"; // import x from 'no'
import './side';
import def, * as all from "pkg";
const f = () => go(1);
export abstract class Shop<T> extends Base<T> implements I {
  private items = load();
  constructor(private x: Foo) { super(x); this.init(); }
  abstract price(a: number): number;
  async total(n = {a: 1}): Promise<number> {
    if (n) { return this.items.reduce((s, i) => add(s, i), 0); }
    switch (n) { case foo(): { new Bar(); } }
    const s = "call(1) {"; /* gone() */ return sum<number>(s);
  }
}
function outer(cb: () => void) {
  function inner() { hidden(); }
  inner(); x ? yes() : no();
}
"""


def test_graph_of():
    nodes, edges = graph_of(SHOP)
    assert [(n["path"], n["kind"], n["start_line"], n["end_line"]) for n in nodes] == [
        ("Shop", "class", 5, 14),
        ("Shop.price", "method", 8, 8),
        ("Shop.total", "method", 9, 13),
        ("outer", "function", 15, 18),
        ("outer.inner", "function", 16, 16),
        ("file", "file", 1, 19),
    ]
    calls = {(e["path"], e["target"]) for e in edges if e["relation"] == "calls"}
    assert calls == {("Shop", "load"), ("Shop", "init"), *(("Shop.total", x) for x in ("reduce", "add", "foo", "sum")), ("outer.inner", "hidden"), ("outer", "inner"), ("outer", "yes"), ("outer", "no")}
    assert [e["target"] for e in edges if e["relation"] == "imports"] == ["./lib", "./side", "pkg"]


def _calls(text, jsx=False):
    return {(e["path"], e["target"]) for e in graph_of(text, jsx)[1] if e["relation"] == "calls"}


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("return `${go(1)}`;", {"go"}),
        ("return `a ${x ? `b ${inner(`${deep()}`)} c(` : ''} d(`;", {"inner", "deep"}),
        ("return `\\${no()} \\` ${yes()} $ {no()}`;", {"yes"}),
        ("const r = /['\"`(]/g.test(s); go();", {"test", "go"}),
        ("return /[/'(]no(/.exec(go(s));", {"exec", "go"}),
        ("const x = a / b; const s = '/'; go(x / 2);", {"go"}),
        ("/* no() */ // no()\n go('no()');", {"go"}),
        ("return tag(x)`${y}`;", {"tag"}),
        ("return { a: `${{ k: go() }.k}` };", {"go"}),
        ("return `${", set()),
    ],
)
def test_templates_and_expressions(body, want):
    found = _calls(f"function f(s) {{ {body} }}")
    assert {t for p, t in found} == want and {p for p, _ in found} <= {"f"}


def test_elements():
    text = "function App(p) { const n = p.a < p.b; return (<div title={name(p)} alt='no('>It's no(1) {items(p).map((i) => <Row key={key(i)} />)} <>{last()}</></div>); }\nfunction next() { run(); }"
    assert _calls(text, jsx=True) == {*(("App", x) for x in ("name", "items", "map", "key", "last")), ("next", "run")}
    assert _calls("function f(a) { return <T>(x) => g<string>(a); }") == {("f", "g")}


def test_code_stays_in_place():
    text = "a = `x\n${b}\n`; /* c\n*/ 'd'; /e/ f\n"
    code = code_of(text)
    assert len(code) == len(text) and [k for k, c in enumerate(text) if c == "\n"] == [k for k, c in enumerate(code) if c == "\n"]
    assert all(c in (text[k], " ", ",") for k, c in enumerate(code)) and code.split() == ["a", "=", ",{b}", ";", ";", "f"]


def test_line_graph(spark):
    text = "import os\nclass A:\n    def one(self):\n        go(1)\n\ndef top():\n    one()\n"
    nodes, edges = codegraph.line_graph(spark.createDataFrame([("p", "/a.py", text), ("p", "/b.ts", text), ("p", "/c.md", text)], "project_path string, file_path string, text string"))
    rows = {r.node_id: r.symbol_path for r in nodes.collect()}
    assert sorted(rows.values()) == ["A", "A.one", "file", "top"]
    assert {(rows[r.source_node_id], r.target_node_name, r.relationship_type) for r in edges.collect()} == {("A.one", "go", "calls"), ("top", "one", "calls"), ("file", "os", "imports")}


@pytest.mark.parametrize("text", [None, "", "((((", "}}}}) class", "function g(", "import", "import x from", "'", "`${", "/*"])
def test_broken_files_have_no_graph(text):
    assert graph_of(text) == ([], [])


@pytest.mark.parametrize("piece", ["class A <", "abstract ", "x (", '"', "import ", "a<", "/*", "{)", "`${", "/a[", "= /", "= <a "])
def test_long_broken_files_end(piece):
    start = time.time()
    graph_of(piece * 20_000, jsx=True)
    assert time.time() - start < 10


def test_code_graph_of_files(spark):
    files = spark.createDataFrame([("p", "/a.ts", SHOP), ("p", "/b.py", SHOP), ("p", "/c.js", None)], "project_path string, file_path string, text string")
    nodes, edges = codegraph.code_graph(files)
    assert {r.file_path for r in nodes.collect()} == {"/a.ts"} and nodes.count() == 6
    solved = g.resolve(edges, nodes).filter("target_node_id is not null").collect()
    assert [r.target_node_name for r in solved] == ["inner"]
    assert nodes.filter("symbol_type = 'file'").first()["symbol_name"] == "a.ts"
    assert nodes.limit(0).count() == 0 and codegraph.code_graph(files.limit(0))[1].count() == 0


def test_php_kinds(spark):
    rows = [(1, "a.php", "function m_cron() {}\nclass A extends FormBase {}\nclass A extends FormBase {}"), (2, "a.inc", "class S extends X\n\n implements Y, EventSubscriberInterface {\n}\n@Block(\n  \n"), (3, "a.php", None), (4, "a.php", "")]
    got = chunking.php_kinds(spark.createDataFrame(rows, "id int, file_path string, text string"), "id")
    assert sorted((r.id, r.line, r.kind, r.name) for r in got.collect()) == [(1, 2, "form", "A"), (1, 3, "form", "A"), (2, 1, "event_subscriber", "S"), (2, 5, "plugin", "Block")]


def test_services_and_routes(spark):
    rows = [("a", '{"services": {"s": {"class": "C", "tags": "odd"}, "t": null, "u": "@s"}}'), ("b", '{"services": []}'), ("c", "[1]"), ("d", None)]
    files = spark.createDataFrame(rows, "file_path string, data string")
    assert [tuple(r) for r in catalogs.services(files).collect()] == [("s", "C", [], "a")]
    routes = spark.createDataFrame([("a", '{"r": {"path": "/x", "defaults": {"_controller": "", "_form": "F"}}, "_x": "y"}'), ("b", "no json")], "file_path string, data string")
    assert [tuple(r) for r in catalogs.routes(routes).collect()] == [("r", "/x", "F", "a")]


def test_many_php_matches(spark):
    n = 100_000
    text = "<?php\n" + "".join(f"function m_{k}(\n) {{}}\n" for k in range(n))
    start = time.time()
    got = chunking.php_kinds(spark.createDataFrame([(1, "m.module", text)], "id int, file_path string, text string"), "id").agg(F.count("*"), F.max("line"), F.min("line")).first()
    assert tuple(got) == (n, 2 * n, 2) and time.time() - start < 60
