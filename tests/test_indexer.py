"""The indexing flow: changes, symbols, words, pause and resume, interruption, lease, failures, repairs, keyed tables."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates, html
from lodestone.operators import chunking, folder, keyed, runs, wordindex
from lodestone.operators.folder import Conflict, Folder, Lease, Locked, Lost
from lodestone.operators.indexer import Indexer
from lodestone.operators.keyed import Keyed
from lodestone.operators.tables import Tables
from lodestone.operators.wordindex import WordIndex
from lodestone.streaming.drain import hash_embedder

FILES = "file_path string, size long, mtime_ns long, hash string, text string"


def _files(spark, texts):
    return spark.createDataFrame([(p, len(t), 1, t, t) for p, t in texts.items()], FILES)


def _state(index):
    queue, vectors = index.queue.read(), index.vectors.read()
    return {(r.file_path, r.status) for r in queue.collect()}, {r.chunk_id for r in vectors.collect()} == {r.chunk_id for r in queue.filter("status = 'embedded'").collect()}


def test_files_come_change_and_go(spark, tmp_path):
    seen = []

    def embed(batch):
        seen.extend(r.file_path for r in batch.select("file_path").collect())
        return hash_embedder(batch)

    index = Indexer(spark, str(tmp_path / "index"), embed, clock=lambda: 1000.0)
    index.start(_files(spark, {"a.py": "def a():\n  pass", "b.md": "words", "c.md": "more"}))
    assert _state(index) == ({("a.py", "embedded"), ("b.md", "embedded"), ("c.md", "embedded")}, True)
    assert sorted(seen) == ["a.py", "b.md", "c.md"]
    del seen[:]
    index.start(_files(spark, {"a.py": "def a():\n  pass", "b.md": "other words"}))
    assert seen == ["b.md"] and _state(index) == ({("a.py", "embedded"), ("b.md", "embedded")}, True)
    assert index.runs.read().filter("status = 'completed'").count() == 2
    assert index.progress(10.0).first()["percent"] == 100.0
    assert sorted((r.pending, r.embedded, r.errors, r.files) for r in index.stats.read().collect()) == [(0, 2, 0, 2), (0, 3, 0, 3)]
    assert all(healthy for _, healthy, _ in index.health())
    assert index.words.counts()[0] == 2 and [r.chunk_id for r in index.words.top_k("more", 5).collect()] == []
    index.vacuum()
    assert _state(index)[1] and index.status().first()["embedded"] == 2
    assert index.delete() and not index.delete() and index.queue.version() == 0


APP = "import { b } from './lib';\nexport class Shop {\n  total() { return `${price(1)}`; }\n}\nfunction main() { price(2); }\n"


def test_an_index_can_be_searched(spark, tmp_path):
    texts = {"src/app.ts": APP, "src/lib.ts": "export function price(x) { return tax(x); }\n", "tool.py": "class T:\n    def run(self):\n        price(3)\n", "page.html": "<p>an <b>orange</b> boat</p><script>no()</script>", "data.json": '{"orange": 1}', "logo.png": "orange"}
    index = Indexer(spark, str(tmp_path / "index"), hash_embedder, clock=lambda: 1000.0, project="demo")
    index.start(_files(spark, texts))
    engine = index.engine(lambda q: [0.1] * 8)
    rows = {r.file_path: r for r in engine.chunks.collect()}
    assert set(rows) == set(texts) - {"data.json", "logo.png"}
    assert rows["page.html"]["text"] == "an orange boat" and rows["page.html"]["language"] == "html" and rows["src/app.ts"]["language"] == "typescript"
    assert rows["tool.py"]["class_name"] == "T" and rows["tool.py"]["project_path"] == "demo" and rows["tool.py"]["schema_version"] == "1.0"
    assert [r["file_path"] for r in engine.keyword("orange").page] == ["page.html"]
    assert {r["file_path"] for r in engine.search("price", gap=0.0).page} >= {"src/app.ts", "src/lib.ts"}
    assert {r.source_path for r in engine.callers("price").collect()} == {"Shop.total", "main", "T.run"}
    assert [list(r.path) for r in engine.path("main", "tax").collect()] == [["main", "price", "tax"]]
    assert {r.file_path for r in engine.context_pack("orange", neighbors=False).collect()} == {"page.html"}
    assert engine.similar(file_path="lib.ts", limit=2).count() == 2
    held = {r.symbol_path: r.chunk_id for r in index.nodes.read().collect()}
    assert held["main"] == rows["src/app.ts"]["chunk_id"] and held["price"] == rows["src/lib.ts"]["chunk_id"]
    # the definition goes: its calls are unresolved; it comes elsewhere: they are resolved again
    del texts["src/lib.ts"]
    index.start(_files(spark, texts))
    edges = {r.target_node_name: r.target_node_id for r in index.edges.read().filter("relationship_type = 'calls'").collect()}
    assert edges == {"price": None}
    index.start(_files(spark, texts | {"new.js": "function price() {}"}))
    target = index.nodes.read().filter("symbol_path = 'price'").first()
    assert target.file_path == "new.js" and {r.target_node_id for r in index.edges.read().filter("target_node_name = 'price'").collect()} == {target.node_id}
    assert {r.check: r["count"] for r in index.doctor().collect()} == dict.fromkeys(["missing_vectors", "extra_vectors", "other_versions", "queue_errors", "parse_errors"], 0)


def test_pause_resume_and_lease(spark, tmp_path):
    now, taken = [1000.0], []

    def embed(batch):
        taken.append(batch.count())
        if len(taken) == 1:
            index.pause(index.lease.holder())
        return hash_embedder(batch)

    index = Indexer(spark, str(tmp_path / "index"), embed, batch=2, clock=lambda: now[0])
    run = index.start(_files(spark, {f"f{i}.md": f"text {i}" for i in range(5)}))
    assert taken == [2] and index.runs.read().first()["status"] == "paused"
    index.resume(run)
    assert taken == [2, 2, 1] and index.runs.read().first()["status"] == "completed" and _state(index)[1]
    other = Lease(Folder(spark, str(tmp_path / "index")), index.clock)
    other.take("other")
    with pytest.raises(Locked):
        index.start(_files(spark, {"z.md": "z"}))
    now[0] = 1700.0  # silent for longer than a lease lasts
    index.start(_files(spark, {"z.md": "z"}))
    assert _state(index) == ({("z.md", "embedded")}, True)
    with pytest.raises(Lost):
        other.beat()


def test_a_run_without_its_lease_writes_nothing(spark, tmp_path):
    now = [1000.0]

    def slow(batch):
        now[0] += 700
        thief.lease.take("thief")
        return hash_embedder(batch)

    index = Indexer(spark, str(tmp_path / "index"), slow, clock=lambda: now[0])
    thief = Indexer(spark, str(tmp_path / "index"), hash_embedder, clock=lambda: now[0])
    with pytest.raises(Lost):
        index.start(_files(spark, {"a.md": "x"}))
    assert _state(index) == ({("a.md", "pending")}, True) and thief.lease.holder() == "thief"
    thief._let_go()
    thief.resume("again")
    assert _state(index) == ({("a.md", "embedded")}, True)


def test_of_many_takers_one_holds(spark, tmp_path):
    won, barrier = [], threading.Barrier(8)

    def take(k):
        lease = Lease(Folder(spark, str(tmp_path)))
        barrier.wait()
        try:
            lease.take(f"run {k}")
            won.append(k)
        except Locked:
            pass

    threads = [threading.Thread(target=take, args=(k,)) for k in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and Lease(Folder(spark, str(tmp_path))).holder() == f"run {won[0]}"


def test_three_failed_batches_end_a_run(spark, tmp_path):
    def down(batch):
        raise OSError("no server")

    index = Indexer(spark, str(tmp_path / "index"), down, batch=1)
    index.start(_files(spark, {f"{i}.md": f"x {i}" for i in range(5)}))
    last = index.runs.read().first()
    assert (last.status, last.message) == ("error", "no server")
    assert sorted(r.status for r in index.queue.read().collect()) == ["error"] * 3 + ["pending"] * 2
    assert {r.check: r["count"] for r in index.doctor(fix=True).collect()}["queue_errors"] == 3
    assert {(r.status, r.retry_count) for r in index.queue.read().collect()} == {("pending", 0)}
    queue = index.queue.read().withColumn("status", F.lit("error"))
    assert {r.status for r in runs.retried(queue).collect()} == {"pending"}


def test_an_embedder_that_leaves_rows_out(spark, tmp_path):
    index = Indexer(spark, str(tmp_path / "index"), lambda batch: hash_embedder(batch.filter("file_path = 'a.md'")))
    index.start(_files(spark, {"a.md": "x", "b.md": "y"}))
    assert _state(index) == ({("a.md", "embedded"), ("b.md", "error")}, True)


def test_files_that_cannot_be_chunked(spark, tmp_path):
    def chunker(files):
        good = chunking.chunk_files(files.filter("file_path <> 'bad.md'"))
        return good.unionByName(files.filter("file_path = 'bad.md'").select("file_path", F.lit("broken").alias("error")), allowMissingColumns=True)

    index = Indexer(spark, str(tmp_path / "index"), hash_embedder, chunker=chunker)
    for n in (1, 3, 3):
        if n == 3:  # as after a second try
            index.lease.take("test")
            index.files.change(index.files.read().filter("status = 'parse_error' AND retry_count < 3").withColumn("retry_count", F.lit(2).cast("long")))
            index.lease.release()
        index.start(_files(spark, {"bad.md": "x", "good.md": "y"}))
        assert {(r.file_path, r.status, r.retry_count, r.message) for r in index.files.read().collect()} == {("bad.md", "parse_error", n, "broken"), ("good.md", "parsed", 0, None)}
    index.start(_files(spark, {"bad.md": "other", "good.md": "y"}))
    assert {r.retry_count for r in index.files.read().filter("file_path = 'bad.md'").collect()} == {1}
    assert {r.check: r["count"] for r in index.doctor().collect()}["parse_errors"] == 1


def test_keyed_table(spark, tmp_path, monkeypatch):
    """Random batches against a dict; layers are merged, buckets doubled, what isn't read removed."""
    import random

    monkeypatch.setattr(keyed, "LAYERS", 3)
    monkeypatch.setattr(keyed, "BUCKET_BYTES", 4000)
    rng, want = random.Random(1), {}
    table = Keyed(spark, str(tmp_path / "t"), "k long, v string, n int", ["k"], buckets=2)
    assert table.read().count() == 0 and table.at(1).count() == 0
    for step in range(9):
        put = {rng.randrange(200): f"{step}" * rng.randrange(60) for _ in range(rng.choice([1, 40]))}
        gone = rng.sample(range(200), 15)
        table.change(spark.createDataFrame(list(put.items()), "k long, v string"), spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: v for k, v in want.items() if k not in gone} | put
        assert {r.k: r.v for r in table.read().collect()} == want
    assert all(len(v) <= 4 for v in table.commits.last()[1]["layers"].values()) and table.commits.last()[1]["buckets"] > 2
    some = next(iter(want))
    assert [r.v for r in table.at(some).collect()] == [want[some]]
    assert table.vacuum() and {r.k: r.v for r in table.read().collect()} == want
    assert not Folder(spark, str(tmp_path / "t")).exists("_v=1")


def test_bytes_written_grow_with_the_batch(spark, tmp_path):
    table = Keyed(spark, str(tmp_path / "t"), "k long, v string", ["k"], buckets=8)
    row = F.sha2(F.col("id").cast("string"), 512).alias("v")
    table.change(spark.range(200_000).select(F.col("id").alias("k"), row))
    first = table.commits.last()[1]["written"]
    table.change(spark.range(2_000).select((F.col("id") * 50).alias("k"), row))
    assert table.commits.last()[1]["written"] < first / 40 and table.read().count() == 200_000


def test_of_two_writers_the_second_fails(spark, tmp_path):
    a, b = (Keyed(spark, str(tmp_path / "t"), "k long", ["k"]) for _ in range(2))
    a.change(spark.range(1).withColumnRenamed("id", "k"))
    late = b.commits.last()
    a.change(spark.range(2).withColumnRenamed("id", "k"))
    b.commits.last = lambda: late
    with pytest.raises(Conflict):
        b.change(spark.range(9).withColumnRenamed("id", "k"))
    assert a.read().count() == 2
    assert Folder(spark, str(tmp_path)).create("x", "1") and not Folder(spark, str(tmp_path)).create("x", "2") and Folder(spark, str(tmp_path)).text("x") == "1"
    assert folder.LEASE_SECONDS == runs.LOCK_SECONDS


def test_probe(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    tables.write("x", spark.range(1))
    tables.write("bad", spark.range(1))
    for part in (tmp_path / "t" / "bad" / "v=1").glob("part-*"):
        part.write_bytes(b"no parquet")
    assert [(name, healthy) for name, healthy, _ in tables.probe(["x", "y", "bad"])] == [("x", True), ("y", False), ("bad", False), ("folder", True)]
    (tmp_path / "file").write_text("")
    assert tables.probe([])[0][1] and not Tables(spark, str(tmp_path / "file" / "t")).probe([])[0][1]


def test_half_written_versions_are_not_seen(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.read("x", "a long").count() == 0
    for i in range(4):
        tables.write("x", spark.range(i).withColumnRenamed("id", "a"))
    (tmp_path / "t" / "x" / "v=4" / "_SUCCESS").unlink()
    assert tables.version("x") == 3 and tables.read("x", "a long").count() == 2
    tables.vacuum("x", keep=1)
    assert not (tmp_path / "t" / "x" / "v=1").exists() and tables.read("x", "a long").count() == 2


EXCERPTS = [("p", True, 0, "<p class='a b'>x<p>y</p></p>"), ("p", False, 0, "x<p>y</p>"), (".b", False, 3, "x<p"), ("#q", True, 0, "<i id=q>z</i>"), ("br", True, 0, "<br>"), ("br", False, 0, ""), ("u", True, 0, None), ("b", True, 0, "<b>open")]


def test_excerpt(spark):
    pages = spark.createDataFrame([(1, "<div>\n<p class='a b'>x<p>y</p></p><i id=q>z</i><br><b>open"), (2, None)], "page_id int, html string")
    for selector, outer, n, want in EXCERPTS:
        assert {r.page_id: r.excerpt for r in html.excerpts(pages, selector, outer, n).collect()} == {1: want, 2: None}


def test_epoch(spark):
    rows = [("-1 day", 913_600), ("2 weeks ago", 1_000_000 - 1_209_600), ("+3 min", 1_000_180), ("now", 1_000_000), ("17", 17), ("1970-01-02", 86_400), ("1970-01-01T00:00:05Z", 5), ("soon", None), ("", None), (None, None), ("1970-99-99", None)]
    got = spark.createDataFrame(rows, "t string, want long").select(dates.epoch(F.col("t"), 1_000_000).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_words_of_an_index_without_any(spark, tmp_path):
    """Segments without words, or without chunks, are merged and searched like others."""
    index = WordIndex(spark, str(tmp_path / "words"))
    rows = lambda *x: spark.createDataFrame(x, "chunk_id string, text string")
    index.change(rows(("a", ""), ("b", None)))
    assert index.counts() == (2, 0, 1) and index.top_k("orange", 3).count() == 0
    index.change(rows(("c", "orange boat")))
    index.change(rows(("x", "")).limit(0), rows(("a", "")))
    assert index.counts() == (2, 2, 2) and [r.chunk_id for r in index.top_k("orange", 3).collect()] == ["c"]
    for n in range(wordindex.SEGMENTS):
        index.change(rows((f"d{n}", "")))
    assert index.counts()[:2] == (2 + wordindex.SEGMENTS, 2) and index.counts()[2] < wordindex.SEGMENTS and [r.chunk_id for r in index.bm25(["orange"]).collect()] == ["c"]
