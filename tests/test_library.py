"""Operators against plain loops, invariants and golden cases on small inputs."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.functions import html
from lodestone.functions import text as t
from lodestone.operators import catalogs, chunking, context, graph, health, incremental, ivf, ops, retrieval, snapshots
from lodestone.plans.inputs import QUERY_VECTOR, vectors
from lodestone.sources import files, yaml
from lodestone.streaming import drain

SMALL = "/root/testdata/sf0.001"


# --- query terms -------------------------------------------------------------


def test_query_terms():
    assert t.identifiers('call getUserName with HTTP404 in a.b_c and "the phrase" v1.2.3') == ["getUserName", "b_c", "a.b_c", "HTTP404", "v1.2.3", "the phrase"]
    assert t.terms("  The  foo.bar the x ") == ["the", "foo.bar"]
    assert t.keywords("what IS the parser") == ["parser"]


@pytest.mark.parametrize("keep,want", [("head", "abcdefgh …"), ("tail", "… cdefghij"), ("middle", "abc\n…\nij")])
def test_truncate(spark, keep, want):
    row = spark.createDataFrame([("abcdefghij",)], "x string").select(t.truncate(F.col("x"), 8, keep), t.truncate(F.col("x"), 10, keep), t.truncate(F.col("x"), 0, keep)).first()
    assert tuple(row) == (want, "abcdefghij", "abcdefghij")


def test_truncate_shorter_than_the_mark(spark):
    assert spark.createDataFrame([("abcdef",)], "x string").select(t.truncate(F.col("x"), 3)).first()[0] == "abc"


def test_strip_markup(spark):
    rows = ["<p>a</p><script>x<b></script> b", "&amp;lt; &nbsp;  c", "<STYLE>p{}</STYLE>d", "\u00a0 e \n"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(t.strip_markup(F.col("x"))).collect()]
    assert got == ["a b", "< c", "d", "e"]


def test_whole_word_knows_no_accents(spark):
    frame = spark.createDataFrame([("éfoo bar",), ("xfoo",), ("FOO_1",), ("(Foo)",)], "x string")
    assert [r[0] for r in frame.select(t.whole_word(F.col("x"), "foo")).collect()] == [True, False, False, True]


# --- ranking -----------------------------------------------------------------


def _scored(spark, scores):
    return spark.createDataFrame([(chr(97 + i), float(s)) for i, s in enumerate(scores)], "chunk_id string, score double")


@pytest.mark.parametrize("scores,threshold,want", [([1.0, 0.95, 0.2, 0.1], 0.25, "ab"), ([1.0, 0.9, 0.8], 0.25, "abc"), ([1.0, 0.1], 0.0, "ab"), ([0.0, -5.0], 0.25, "ab"), ([3.0], 0.25, "a")])
def test_gap_cut(spark, scores, threshold, want):
    assert "".join(r.chunk_id for r in retrieval.gap_cut(_scored(spark, scores), threshold).orderBy("rank").collect()) == want


def test_fusion_and_boost_cap(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "chunk_id string, rank long")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "chunk_id string, rank long")
    got = {r.chunk_id: r.score for r in retrieval.fuse(a, b).collect()}
    assert math.isclose(got["y"], 0.65 / 62 + 0.35 / 61) and math.isclose(got["x"], 0.65 / 61) and math.isclose(got["z"], 0.35 / 62)
    rows = spark.createDataFrame([("x", 0.0, "alpha beta gamma")], "chunk_id string, score double, text string")
    assert retrieval.boosted(rows, ["alpha", "Beta", "gamma", "delta"]).first().boost == 0.30


def test_recency_needs_a_time(spark):
    rows = spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, None)], "chunk_id string, score double, mtime_ns long")
    got = {r.chunk_id: r.score for r in retrieval.recent(rows, 30 * 86_400_000_000_000).collect()}
    assert math.isclose(got["a"], 1 + 0.1 * math.exp(-1)) and got["b"] == 1.0


def test_zero_vectors_and_odd_lengths_have_no_distance(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [1.0]), ("d", None)], "chunk_id string, vector array<float>")
    assert [(r.chunk_id, r.distance) for r in retrieval.vector_top_k(rows, [1.0, 0.0], 5).collect()] == [("b", 0.0)]


def test_filters_reach_the_scan(spark):
    plan = retrieval.scoped(spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("schema_version", F.lit("1.0")).withColumnRenamed("lang", "language"), retrieval.Filters(language="fr"))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,fr)" in plan


@pytest.mark.parametrize("reply,want", [("[2, 1]", [2, 1]), ("Sure: [3,3,9] done", [3]), ("none", []), ("[]", []), ("[1, x, 2]", [1, 2])])
def test_parse_order(reply, want):
    assert context.parse_order(reply, 4) == want


@pytest.mark.parametrize("keep", ["middle", "head", "tail"])
def test_pack_against_a_loop(spark, keep):
    rng = random.Random(len(keep))
    rows = [(f"{f}:{i}", str(f), i, "x" * rng.randrange(1, 60)) for f in range(6) for i in range(8)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_path string, start_line long, text string")
    hits = rng.sample([r[:2] for r in rows], 12)
    frame = spark.createDataFrame([(c, f, k) for k, (c, f) in enumerate(hits, 1)], "chunk_id string, file_path string, rank long")
    got = {r.chunk_id: r.excerpt for r in context.pack(chunks, frame, max_files=3, max_chars=400, hops=1, keep=keep).collect()}
    text, allowed, seen, used, want = {r[0]: r[3] for r in rows}, [], set(), 0, {}
    for _, f in hits:
        if f not in allowed and len(allowed) < 3:
            allowed.append(f)
    for c, f in hits:
        if f not in allowed:
            continue
        i = int(c.split(":")[1])
        for k in [i, *(x for x in (i - 1,) if x >= 0), *(x for x in (i + 1,) if x < 8)]:
            ident = f"{f}:{k}"
            if ident in seen:
                continue
            seen.add(ident)
            room = 400 - used
            used += len(text[ident])
            if room <= 0:
                continue
            body = text[ident]
            if len(body) > room:
                if keep == "head":
                    body = body[:room] + " …"
                elif keep == "tail":
                    body = "… " + body[len(body) - room :]
                elif room <= 3:
                    body = body[:room]
                else:
                    body = body[: -(-(room - 3) // 2)] + "\n…\n" + (body[-((room - 3) // 2) :] if (room - 3) // 2 else "")
            want[ident] = body
    assert got == want


# --- chunks ------------------------------------------------------------------


def _source(rng, n):
    kinds = ["def f{i}(x):", "class C{i}:", "    def m{i}(self):", "    return {i}", "", "x = {i}", "async def g{i}():"]
    return "\n".join(rng.choice(kinds).format(i=i) for i in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_code_chunks(seed):
    rng = random.Random(seed)
    text = _source(rng, rng.choice([1, 50, 121, 400]))
    chunks = chunking.code_chunks(text, "python")
    lines = text.split("\n")
    assert all(c["end_line"] - c["start_line"] < chunking.MAX_LINES and len(c["raw_text"]) <= chunking.MAX_CHARS for c in chunks)
    assert all(b["start_line"] == a["end_line"] + 1 for a, b in zip(chunks, chunks[1:]))
    for c in chunks:
        assert c["raw_text"] == "\n".join(lines[c["start_line"] - 1 : c["end_line"]])[: chunking.MAX_CHARS]
        if c["end_line"] < len(lines) and c["end_line"] - c["start_line"] < chunking.MAX_LINES - 1:
            assert re.match(r"\s*(?:async def|def|class) ", lines[c["end_line"]])
        first = next((x for x in lines[c["start_line"] - 1 : c["end_line"]] if re.match(r"\s*(?:async\s+def|def|class)\s", x)), None)
        assert (c["node_type"] == "code_block") == (first is None)


def test_every_character_of_code_is_in_a_chunk():
    rng = random.Random(7)
    text = "\n".join("x" * rng.choice([0, 10, 199, 200, 3999, 4000, 4001, 9000]) for _ in range(150))
    chunks = chunking.code_chunks(text, "python")
    assert all(len(c["raw_text"]) <= chunking.MAX_CHARS for c in chunks)
    assert "".join(c["raw_text"] for c in chunks).replace("\n", "") == text.replace("\n", "")
    assert all(a["end_line"] <= b["start_line"] or a["end_line"] == b["end_line"] for a, b in zip(chunks, chunks[1:]))


def test_code_chunk_scope():
    text = "class A:\n    def one(self):\n        pass\n" + "    x = 1\n" * 130 + "    def two(self):\n        pass\n"
    first, second = chunking.code_chunks(text, "python")
    assert (first["class_name"], first["function_name"], first["node_type"]) == ("A", None, "class_definition")
    assert (second["class_name"], second["symbol_path"]) == ("A", "A.two")
    assert chunking.code_chunks("   \n\n", None) == []


@pytest.mark.parametrize("language,line,want", [("typescript", "export default class Foo {", ("class_declaration", "Foo")), ("typescript", "  constructor(x) {", None), ("javascript", "  constructor(x) {", ("method_definition", "constructor")), ("go", "func (s *T) Run() {", ("function_declaration", "Run")), ("rust", "pub(crate) async fn go() {", ("function_item", "go")), ("php", "final class X {", ("class_declaration", "X")), ("java", "public static int add(int a) {", ("method_declaration", "add")), ("c", "static int add(int a)", ("function_definition", "add")), ("cpp", "namespace app {", ("class_specifier", "app")), ("cpp", "std::vector<int> Box::sizes(int n) const {", None), ("cpp", "static inline int total(int a) {", ("function_definition", "total")), ("cpp", "  while (x) {", None)])
def test_boundaries(language, line, want):
    rules = [(k, re.compile(p, re.ASCII), n) for k, p, n in chunking.BOUNDARIES[language]]
    assert chunking.boundary(line, rules) == want


def test_cpp_chunks():
    text = "class Box {\n public:\n" + "  int x;\n" * 112 + "  virtual int size(int n) {\n    return n;\n  }\n" + "  // pad\n" * 20 + "};\n}\nint main(int argc) {\n  return 0;\n}"
    got = [(c["start_line"], c["end_line"], c["node_type"], c["class_name"], c["function_name"], c["symbol_path"]) for c in chunking.code_chunks(text, chunking.EXTENSIONS["hpp"])]
    assert got == [(1, 114, "class_specifier", "Box", None, None), (115, 142, "function_definition", "Box", "size", "Box.size")]


@pytest.mark.parametrize("seed", range(6))
def test_prose_chunks(seed):
    rng = random.Random(seed)
    paras = [" ".join("word" for _ in range(rng.choice([3, 40, 300]))) for _ in range(rng.randrange(1, 12))]
    chunks = chunking.prose_chunks("\n\n".join(paras), 500)
    assert all(len(c["raw_text"]) <= 500 and c["start_line"] <= c["end_line"] for c in chunks)
    assert [c["start_line"] for c in chunks] == sorted(c["start_line"] for c in chunks)
    assert "".join(c["raw_text"] for c in chunks).replace("\n", "").replace(" ", "") == "".join(paras).replace(" ", "")


def test_chunk_frames(spark):
    rows = spark.createDataFrame([(1, "def a():\n  b()", "/x.py"), (2, None, "/y.md"), (3, "text", "/z.txt")], "id int, text string, file_path string")
    assert {(r.id, r.node_type) for r in chunking.chunk_code(rows, "id").collect()} == {(1, "function_definition"), (3, "code_block")}
    assert {r.id for r in chunking.chunk_prose(rows, "id").collect()} == {1, 3}


def test_outline():
    got = html.outline("<div id=a><p class='c'>x <b>y</b></p><br>z</div><p>w")
    assert [(n, p, d, tag, e, c, text) for n, p, d, tag, e, c, text in got] == [(0, None, 0, "div", "a", None, "x yz"), (1, 0, 1, "p", None, "c", "x y"), (2, 1, 2, "b", None, None, "y"), (3, 0, 1, "br", None, None, ""), (4, None, 0, "p", None, None, "w")]
    assert html.outline(None) == []


# --- graph -------------------------------------------------------------------


@pytest.fixture(scope="module")
def web(spark):
    rng = random.Random(9)
    nodes = [(f"n{i}", f"s{i % 17}", f"m.s{i % 17}.{i}", "function", f"f{i % 5}", i) for i in range(25)]
    edges = [(f"n{rng.randrange(25)}", *((f"s{nodes[k][1][1:]}", f"n{k}") if (k := rng.randrange(32)) < 25 else (f"ext{k}", None)), rng.choice(["calls", "imports"])) for _ in range(45)]
    frames = spark.createDataFrame(nodes, "node_id string, symbol_name string, symbol_path string, symbol_type string, file_path string, start_line int"), spark.createDataFrame(edges, "source_node_id string, target_node_name string, target_node_id string, relationship_type string")
    return nodes, edges, frames


def test_callers_and_callees(web):
    nodes, edges, frames = web
    name, path = {n[0]: n[1] for n in nodes}, {n[0]: n[2] for n in nodes}
    level, seen, want = {"s3"}, {"s3"}, []
    for d in (1, 2, 3):
        hits = [e for e in edges if e[1] in level]
        want += [(d, path[e[0]], e[1], e[3]) for e in hits]
        level = {name[e[0]] for e in hits} - seen
        seen |= level
    got = [(r.depth, r.source_path, r.target_node_name, r.relationship_type) for r in graph.callers(*frames, "s3", 3).collect()]
    assert sorted(got) == sorted(want)
    root = min(n[0] for n in nodes if "s3" in (n[1], n[2]))
    level, seen, want = {root}, {root}, []
    for d in (1, 2, 3):
        hits = [e for e in edges if e[0] in level]
        want += [(d, path[e[0]], path.get(e[2], e[1])) for e in hits]
        level = {e[2] for e in hits if e[2]} - seen
        seen |= level
    assert sorted((r.depth, r.source, r.target) for r in graph.callees(*frames, "s3", 3).collect()) == sorted(want)


def test_trace_path(web):
    nodes, edges, frames = web
    path = {n[0]: n[2] for n in nodes}
    for source, target in (("n1", "n7"), ("n2", "n2"), ("n4", "n19"), ("n0", "n11")):
        level, seen, want = {source: [path[source]]}, {source}, None
        while level and want is None:
            want = level.get(target)
            step = {}
            for a, b in ((e[0], e[2]) for e in edges if e[3] == "calls" and e[2]):
                if a in level and b not in seen:
                    step[b] = min(step.get(b, [chr(1114111)]), level[a] + [path[b]])
            seen |= set(step)
            level = step
        rows = graph.trace_path(*frames, path[source], path[target]).collect()
        assert (rows[0].path if rows else None) == want


def test_trace_path_has_no_longest(spark):
    nodes = spark.createDataFrame([(f"n{i}", f"s{i}", f"m.s{i}") for i in range(15)], "node_id string, symbol_name string, symbol_path string")
    calls = [(f"n{i}", f"s{i + 1}", f"n{i + 1}", "calls") for i in range(14)]
    calls += [("n14", "s3", "n3", "calls"), ("n2", "outside", None, "calls"), ("n2", "gone", "n99", "calls")]
    edges = spark.createDataFrame(calls, "source_node_id string, target_node_name string, target_node_id string, relationship_type string")
    path = lambda target: [r.path for r in graph.trace_path(nodes, edges, "m.s0", target).collect()]
    assert path("s14") == [[f"m.s{i}" for i in range(15)]]
    assert path("outside") == [["m.s0", "m.s1", "m.s2", "outside"]]
    assert path("gone") == [["m.s0", "m.s1", "m.s2", "gone"]]
    assert path("nowhere") == []


def test_delete_file(web):
    nodes, edges, frames = web
    left, kept = graph.delete_file(*frames, "f2")
    gone = {n[0] for n in nodes if n[4] == "f2"}
    assert {r.node_id for r in left.collect()} == {n[0] for n in nodes} - gone
    want = [(a, b, None if c in gone else c, d) for a, b, c, d in edges if a not in gone]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want))


def test_enclosing_takes_the_innermost(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 500), ("f", "inner", 100, 110), ("g", "other", 1, 9)], "file_path string, symbol string, start long, end long")
    sites = spark.createDataFrame([("f", 50), ("f", 105), ("f", 120), ("f", 121), ("g", 19), ("g", 20)], "file_path string, line long")
    got = {(r.file_path, r.line): r.symbol for r in graph.enclosing(spans, sites).collect()}
    assert got == {("f", 50): "outer", ("f", 105): "inner", ("f", 120): "inner", ("f", 121): "outer", ("g", 19): "other", ("g", 20): None}


# --- incremental -------------------------------------------------------------


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "c")], "k int, v string")
    once = incremental.upsert(old, new, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "B"), (3, "c")] == sorted(map(tuple, incremental.upsert(once, new, ["k"]).collect()))


def test_interrupted_files_are_taken_again(spark):
    cols = "file_path string, size long, mtime_ns long, hash string"
    scanned = spark.createDataFrame([("same", 1, 1, "h"), ("crashed", 1, 1, "h"), ("touched", 1, 9, "h"), ("edited", 2, 9, "x"), ("new", 1, 1, "h")], cols)
    stored = spark.createDataFrame([(p, 1, 1, "h", s) for p, s in (("same", "parsed"), ("crashed", "pending_parse"), ("touched", "parsed"), ("edited", "parsed"), ("gone", "parsed"))], f"{cols}, status string")
    got = {r.file_path: r.state for r in incremental.changes(scanned, stored).collect()}
    assert got == {"same": "up_to_date", "crashed": "pending_parse", "touched": "up_to_date", "edited": "pending_parse", "new": "new", "gone": "deleted"}
    assert {r.state for r in incremental.changes(scanned, stored, force=True).collect()} == {"pending_parse", "new", "deleted"}


def test_requeue_keeps_what_a_chunk_has(spark):
    queue = spark.createDataFrame([("a", "old", "embedded", 1, 10, 2)], "chunk_id string, raw_text string, status string, priority int, created_at int, retry_count int")
    got = {r.chunk_id: tuple(r)[1:] for r in incremental.requeue(queue, spark.createDataFrame([("a", "new", 3), ("b", "n", 1)], "chunk_id string, raw_text string, priority int"), 99).collect()}
    assert got == {"a": ("new", "pending", 3, 10, 2), "b": ("n", "pending", 1, 99, 0)}


def test_stream_resumes_after_a_failed_batch(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = lambda a, b: spark.createDataFrame([(str(i), f"t{i}", "pending" if i % 2 else "embedded") for i in range(a, b)], "chunk_id string, raw_text string, status string")
    rows(0, 10).write.parquet(source)
    queue = spark.readStream.schema("chunk_id string, raw_text string, status string").parquet(source)
    drain.drain(queue, sink, mark, drain.hash_embedder).awaitTermination()
    rows(8, 20).write.mode("append").parquet(source)

    def broken(batch):
        raise RuntimeError("no embedder")

    with pytest.raises(Exception, match="no embedder"):
        drain.drain(queue, sink, mark, broken).awaitTermination()
    drain.drain(queue, sink, mark, drain.hash_embedder).awaitTermination()
    got = [r.chunk_id for r in drain.latest(spark, sink).collect()]
    assert sorted(got, key=int) == [str(i) for i in range(1, 20, 2)]


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{SMALL}/events.parquet*")
    query = drain.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, drain.windowed(events).collect()))


def test_index_recall(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))
    rows, centres = ivf.build(vectors)
    rows = rows.cache()
    assert rows.count() == vectors.count() and rows.filter("cell is null").count() == 0
    found = total = 0
    for q in [r for r in vectors.collect() if int(r.chunk_id) % 50 == 0]:
        v = [float(x) for x in q.vector]
        exact = {r.chunk_id for r in retrieval.vector_top_k(vectors, v, 10).select("chunk_id").collect()}
        near = {r.chunk_id for r in ivf.top_k(rows, centres, v, 10, probes=15).select("chunk_id").collect()}
        found, total = found + len(exact & near), total + len(exact)
    assert found / total >= 0.9


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_index_recall_at_the_defaults(spark, folder):
    rows, centres = ivf.build(vectors(spark, folder))
    rows = rows.cache()
    held = rows.select("chunk_id", "vector").collect()
    ids, matrix = np.array([r.chunk_id for r in held]), np.array([r.vector for r in held], np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    radius = ivf.radii(rows)
    asked = [(r.vector, u) for r, u in zip(held, matrix, strict=True) if int(r.chunk_id) % 50 == 0][:10] + [(QUERY_VECTOR, np.array(QUERY_VECTOR))]
    found = total = 0
    for v, u in asked:
        want = set(ids[np.argsort(-(matrix @ u), kind="stable")[:10]])
        found += len(want & {r.chunk_id for r in ivf.top_k(rows, centres, [float(x) for x in v], 10, radius=radius).select("chunk_id").collect()})
        total += len(want)
    assert found / total >= 0.9
    exact = retrieval.vector_top_k(rows, QUERY_VECTOR, 20).select("chunk_id", "distance").collect()
    assert catalog.queries()["k12_ivf_top_k"](spark, folder).collect() == exact
    rows.unpersist()


# --- sources -----------------------------------------------------------------


def test_scan(spark, tmp_path):
    tree = {"a.py": "x", "sub/b.md": "y", "sub/deep/c.py": "z", "node_modules/d.py": "n", ".git/e": "g", "img.png": "p", "lib.min.js": "m", "big.txt": "0" * (513 * 1024), "gen/f.py": "f", "gen/keep.py": "k"}
    for name, body in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    names = lambda **f: sorted(r.file_path for r in files.scan(spark, str(tmp_path), **f).collect())
    assert names() == ["a.py", "gen/f.py", "gen/keep.py", "sub/b.md", "sub/deep/c.py"]
    assert names(include=("**/*.py",), exclude=("sub/**",)) == ["a.py", "gen/f.py", "gen/keep.py"]
    assert names(rules=files.ignore_rules("# no\ngen\n!gen/keep.py\n*.md\n")) == ["a.py", "gen/keep.py", "sub/deep/c.py"]
    got = files.scan(spark, str(tmp_path), contents=True).filter("file_path = 'a.py'").first()
    assert got.text == "x" and got.size == 1 and len(got.hash) == 64
    assert [r.file_path for r in files.listing(files.scan(spark, str(tmp_path)), ("*.py",), ("deep", "gen")).collect()] == ["a.py"]


@pytest.mark.parametrize("glob,name,want", [("**/*.py", "a/b.py", True), ("**/*.py", "b.py", True), ("src/*.py", "src/a/b.py", False), ("a?.md", "ab.md", True), ("sub/**", "sub/x/y", True)])
def test_globs(glob, name, want):
    assert bool(re.match(files.glob_pattern(glob), name)) is want


def test_yaml(spark):
    rows = spark.createDataFrame([("a.yml", "b: 1\na: [x]"), ("bad.yml", "a: ["), ("empty.yml", "")], "file_path string, text string")
    assert [(r.file_path, r.data) for r in yaml.parsed(rows).collect()] == [("a.yml", '{"a": ["x"], "b": 1}')]


# --- operations --------------------------------------------------------------


def test_severity_zero_is_a_severity(spark):
    log = spark.createDataFrame([(1, 0), (2, 3)], "wid int, severity int")
    assert [r.wid for r in ops.filter_log(log, severity=0).collect()] == [1]


def test_message_variables(spark):
    frame = spark.createDataFrame([("@a by %b <i>x</i>", {"@a": "1", "%b": "you"})], "m string, v map<string,string>")
    assert frame.select(ops.message(F.col("m"), F.col("v"))).first()[0] == "1 by you x"


def test_empty_log_never_ran(spark):
    log = spark.createDataFrame([], "wid long, severity int, message string, timestamp long")
    assert ops.cron_state(log, 5).first().status == "NEVER_RUN"
    assert ops.health(spark.createDataFrame([], "domain string")).first().health_status == "OK"


def test_snapshot_key_order_is_no_change(spark):
    a = spark.createDataFrame([("x", {"p": "1", "q": "2"}), ("y", {"p": "1"})], "name string, data map<string,string>")
    b = spark.createDataFrame([("x", {"q": "2", "p": "1"}), ("y", {"p": "1", "dependencies": "d"})], "name string, data map<string,string>")
    got = {r.name: (r.status, r.changed_keys, r.risk_level) for r in snapshots.diff(a, b).collect()}
    assert got == {"x": ("identical", [], "low"), "y": ("changed", ["dependencies"], "medium")}


def test_counts_far_apart(spark):
    queue = spark.createDataFrame([(str(i), "embedded") for i in range(300)], "chunk_id string, status string")
    levels = [health.counts_agree(queue, spark.createDataFrame([(str(i),) for i in range(n)], "chunk_id string")).first().level for n in (295, 100, 20)]
    assert levels == ["ok", "warning", "error"]


def test_enrichment(spark):
    rows = ["SUMMARY: does x\nTAGS: A, b\nc", "nothing", "TAGS: " + ",".join(f"t{i}" for i in range(15))]
    got = [r.e for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(catalogs.enrichment(F.col("x")).alias("e")).collect()]
    assert (got[0].summary, got[0].tags) == ("does x", ["a", "b", "c"]) and got[1] is None and len(got[2].tags) == 10


def test_flagship_has_rows(spark):
    assert catalog.FLAGSHIP(spark, SMALL).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(catalog.queries()) <= set(names)
    assert entry.entry(spark).columns[:2] == ["rank", "chunk_id"]


def test_php_symbols_and_hooks(spark):
    text = "<?php\n#[Block]\nfinal class A {\n  public static function go() {}\n}\nfunction node_help() {}\nfunction other_help() {}\ninterface I {}"
    rows = spark.createDataFrame([(1, text, "/m/node.module")], "id int, text string, file_path string")
    assert {(r.line, r.kind, r.name) for r in chunking.php_symbols(rows, "id").collect()} == {(2, "attribute", "Block"), (3, "class", "A"), (4, "function", "go"), (6, "function", "node_help"), (7, "function", "other_help"), (8, "interface", "I")}
    assert [(r.line, r.module, r.hook) for r in chunking.hooks(rows, "id").collect()] == [(6, "node", "help")]


def test_ignore_files_by_folder(spark, tmp_path):
    """Nested ignore files against a plain loop over folders, rules in their order."""
    from lodestone.sources import files as f

    rng = random.Random(11)
    lists = {".keep": "*.log\n/out/\nb*\n!bb.txt\n", "x/.keep": "!*.log\nc.txt\n", "x/y/.keep": "*.log\n!a.log\n/d/\n", "z/.keep": "!b*\n"}
    paths = sorted({"/".join([*rng.choices(["x", "y", "z", "out", "d", "b"], k=rng.randrange(4)), rng.choice(["a.log", "b.txt", "bb.txt", "c.txt", "e.log"])]) for _ in range(300)})
    want = []
    for path in paths:
        gone = False
        parts = path.split("/")
        for d in range(len(parts)):
            text = lists.get("/".join([*parts[:d], ".keep"]))
            for keeps, pattern in f.ignore_rules(text) if text else ():
                if re.search(pattern, "/".join(parts[d:])):
                    gone = not keeps
        if not gone:
            want.append(path)
    rules = f.directory_rules(spark.createDataFrame(list(lists.items()), "file_path string, text string"))
    got = f.not_ignored(spark.createDataFrame([(p,) for p in paths], "file_path string"), rules)
    assert sorted(r.file_path for r in got.collect()) == want and 20 < len(want) < len(paths) - 20
    for name, text in {**lists, **{p: "x" for p in paths}}.items():
        place = tmp_path / name
        place.parent.mkdir(parents=True, exist_ok=True)
        if not place.exists():
            place.write_text(text)
    scanned = {r.file_path for r in f.scan(spark, str(tmp_path), ignore=(".keep",)).collect()}
    assert scanned - set(lists) == set(want)


def test_config_folders(spark, tmp_path):
    from lodestone.sources import config

    (tmp_path / "sync").mkdir()
    for name, text in {"b.two.yml": "k: 1", "a.one.yml": "k: [x]", "a.bad.yml": "k: [", "notes.txt": "k: 1"}.items():
        (tmp_path / "sync" / name).write_text(text)
    folder = config.first_folder(spark, [str(tmp_path / "none"), str(tmp_path / "sync"), str(tmp_path)])
    assert folder == str(tmp_path / "sync") and config.first_folder(spark, [str(tmp_path / "none")]) is None
    files = config.read(spark, folder)
    assert [r.name for r in config.named(files).collect()] == ["a.bad", "a.one", "b.two"] and [r.name for r in config.named(files, "a.", 1).collect()] == ["a.bad"]
    assert sorted((r.name, r.data) for r in config.loaded(files).collect()) == [("a.one", '{"k": ["x"]}'), ("b.two", '{"k": 1}')]


@pytest.mark.parametrize("query", ['the getName of a_b "is" v1.2 ABC', "", "   ", 'IS is "x y" x.y.z E-404 HTTP'])
def test_terms_of_columns(spark, query):
    from lodestone.functions import text as tx

    row = spark.createDataFrame([(query,)], "q string").select(tx.terms_of(F.col("q")).alias("t"), tx.identifiers_of(F.col("q")).alias("i"), tx.keywords_of(F.col("q")).alias("k")).first()
    assert (row.t, row.i, row.k) == (tx.terms(query), tx.identifiers(query), tx.keywords(query))


def test_vector_index(spark, tmp_path):
    """Recall of codes with exact re-ranking, by the defaults, over all ids divisible by 50; additions, ends, and when all is built again."""
    import numpy as np
    from lodestone.operators import pq
    from lodestone.plans.inputs import vectors

    assert [pq.parts_of(d) for d in (1536, 768, 384, 64, 8, 7)] == [96, 96, 96, 4, 1, 1]
    rows = vectors(spark, "/root/testdata/sf0.1")
    index = pq.VectorIndex(spark, str(tmp_path / "index"))
    assert index.refresh(rows) == "built" and index.refresh(rows) == "same"
    own = {r.chunk_id: np.array(r.vector, float) for r in rows.collect()}
    ids = sorted(own)
    unit = np.stack([own[i] / np.linalg.norm(own[i]) for i in ids])
    asked = [i for i in ids if int(i) % 50 == 0]
    got = index.top_k([own[i].tolist() for i in asked], 10).collect()
    found = 0
    for q, i in enumerate(asked):
        near = {ids[k] for k in np.argsort(-(unit @ unit[ids.index(i)]), kind="stable")[:10]}
        found += len(near & {r.chunk_id for r in got if r.q == q})
    assert found / (10 * len(asked)) >= 0.9  # of 200 candidates, a tenth of the rows
    exact = [r.chunk_id for r in index.exact(own[asked[0]].tolist(), 5).collect()]
    assert exact == [ids[k] for k in np.argsort(-(unit @ unit[ids.index(asked[0])]), kind="stable")[:5]]
    less = rows.filter("chunk_id <> '7'").unionByName(spark.createDataFrame([("new", own["9"].tolist())], "chunk_id string, vector array<float>"))
    assert index.refresh(less) == "added" and {r.chunk_id for r in index.top_k([own["9"].tolist()], 2).collect()} == {"9", "new"}
    assert index.rows().filter("chunk_id = '7'").count() == 0 and index.rows().count() == 2000
    assert index.refresh(rows) == "built"  # an id that was gone came again
    many = rows.unionByName(rows.withColumn("chunk_id", F.concat(F.lit("x"), "chunk_id")))
    assert index.refresh(many) == "built" and index.rows().count() == 4000


def test_word_index_in_segments(spark, tmp_path, monkeypatch):
    """After inserts, changes and deletes, over many segments and merges, scores are those of a scan of what is there."""
    from lodestone.operators import wordindex

    monkeypatch.setattr(wordindex, "SEGMENTS", 3)
    monkeypatch.setattr(wordindex, "RANGE", 2)
    monkeypatch.setattr(wordindex, "FIRST", 2)
    rng, have = random.Random(2), {}
    index = wordindex.WordIndex(spark, str(tmp_path / "words"))
    assert index.top_k("alpha", 5).count() == 0
    words = ["alpha", "beta", "gamma", "delta", "the"]
    for step in range(6):
        put = {f"c{rng.randrange(40)}": " ".join(rng.choices(words, [1, 2, 4, 8, 9], k=rng.choice([0, 1, 5, 60]))) for _ in range(12)}
        gone = [f"c{rng.randrange(40)}" for _ in range(3)]
        index.change(spark.createDataFrame(list(put.items()), "chunk_id string, text string"), spark.createDataFrame([(g,) for g in gone if g not in put], "chunk_id string"))
        have = {k: v for k, v in have.items() if k not in gone or k in put} | put
        if step in (0, 3, 5):
            rows = spark.createDataFrame(list(have.items()), "chunk_id string, text string")
            assert index.counts()[:2] == (len(have), sum(len(v.split()) for v in have.values())) and index.counts()[2] <= 3
            want = {r.chunk_id: r.score for r in retrieval.bm25(rows, ["alpha", "delta"]).collect()}
            assert {r.chunk_id: r.score for r in index.bm25(["alpha", "delta"]).collect()} == want
            for k in (1, 4, 100):
                assert index.top_k("alpha delta nowhere", k).collect() == retrieval.keyword_top_k(rows, "alpha delta nowhere", k).collect()
    index.vacuum()
    assert index.top_k("alpha delta nowhere", 4).collect() == retrieval.keyword_top_k(rows, "alpha delta nowhere", 4).collect()
