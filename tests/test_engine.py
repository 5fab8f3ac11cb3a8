"""The engine's searches, what they fall back to, and its cache."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lodestone.engine import Engine, ResultCache, mode_of
from lodestone.operators import retrieval


@pytest.fixture(scope="module")
def tables(spark):
    rows = [("c1", "/a.py", 1, "workflow alias resolver", "fn_a", [1.0, 0.0, 0.0]), ("c2", "/a.py", 11, "database pool settings", "fn_b", [0.0, 1.0, 0.0]), ("c3", "/b.py", 1, "scheduler of nightly jobs", "fn_c", [0.0, 0.0, 1.0]), ("c4", "/b.py", 9, "pool of workers", "fn_d", [0.0, 0.6, 0.8])]
    frame = spark.createDataFrame(rows, "chunk_id string, file_path string, start_line int, text string, function_name string, vector array<float>")
    chunks = frame.drop("vector").withColumns({"project_path": F.lit("/p"), "language": F.lit("py"), "class_name": F.lit(""), "mtime_ns": F.lit(None).cast("long"), "schema_version": F.lit("1.0"), "tags": F.array(F.lit("t"))})
    return chunks.cache(), frame.select("chunk_id", "vector").cache()


@pytest.fixture()
def engine(tables):
    return Engine(chunks=tables[0], vectors=tables[1], embed=lambda q: [0.0, 1.0, 0.0], now_ns=lambda: 0)


def test_hybrid_finds_what_both_legs_find(engine):
    out = engine.search("database pool", gap=0.0)
    assert out.page[0]["chunk_id"] == "c2" and out.mode == "hybrid" and out.total == 4 and not out.has_more
    assert [r["chunk_id"] for r in out.page] == [r["chunk_id"] for r in engine.search("database pool", gap=0.0, fresh=True).page]


def test_paging(engine):
    first, second = (engine.search("pool", gap=0.0, limit=2, offset=o) for o in (0, 2))
    assert first.has_more and not second.has_more
    assert len({r["chunk_id"] for r in first.page + second.page}) == 4


def test_fallbacks(engine, tables):
    def down(query):
        raise OSError("no server")

    broken = Engine(chunks=tables[0], vectors=tables[1], embed=down).search("pool")
    assert broken.mode == "keyword_only" and broken.alpha == 0.0 and "no server" in broken.warnings[0]
    assert [r["chunk_id"] for r in Engine(chunks=tables[0]).keyword("nightly").page] == ["c3"]
    terms = Engine(queue=tables[0]).search("scheduler fn_c")
    assert terms.mode == "terms_only" and terms.page[0]["chunk_id"] == "c3"
    assert engine.semantic("anything", gap=0.0).page[0]["chunk_id"] == "c2"
    assert Engine(chunks=tables[0].limit(0), vectors=tables[1].limit(0), embed=engine.embed).search("pool").page == []
    with pytest.raises(ValueError, match="empty"):
        engine.search("  ")


def test_modes():
    assert [mode_of(*x) for x in ((0.5, True, True), (1.0, True, True), (0.0, True, True), (0.5, False, True), (0.5, False, False))] == ["hybrid", "semantic_only", "keyword_only", "keyword_only", "terms_only"]


def test_context_pack_with_a_judge(engine):
    plain = engine.context_pack("database pool", max_files=1, gap=0.0).collect()
    assert {r["chunk_id"] for r in plain} == {"c1", "c2"}
    judged = engine.context_pack("database pool", max_files=1, gap=0.0, judge=lambda q, texts: str([1 + next(i for i, x in enumerate(texts) if "nightly" in x)])).collect()
    assert {r["chunk_id"] for r in judged} == {"c3", "c4"}
    assert sum(len(r["excerpt"]) for r in engine.context_pack("pool", max_chars=20, gap=0.0).collect()) <= 20


def test_lookups(engine):
    assert [(r["chunk_id"], r["hop"]) for r in engine.neighbors("c1", 1, 1).orderBy("hop").collect()] == [("c1", 0), ("c2", 1)]
    assert engine.get("c3", ["chunk_id", "text", "nope"], 12).first().asDict() == {"chunk_id": "c3", "text": "sched\n…\njobs"}
    assert [r["chunk_id"] for r in engine.similar("c2", 2).collect()] == ["c4", "c1"]
    assert engine.explain("database pool", "c2").first()["rank"] == 1
    assert engine.explain("database pool", "nope").count() == 0


def test_cache_ages_and_forgets():
    now = [0.0]
    cache = ResultCache(rows=2, seconds=10, clock=lambda: now[0])
    keys = [cache.key(q=i) for i in range(3)]
    cache.put(keys[0], "a")
    cache.put(keys[1], "b")
    assert cache.get(keys[0]) == "a"
    cache.put(keys[2], "c")
    assert cache.get(keys[1]) is None and cache.get(keys[0]) == "a"
    now[0] = 11.0
    assert cache.get(keys[0]) is None


@pytest.fixture(scope="module")
def many(spark):
    rows = [(f"k{i:03d}", "/f.py", i, "alpha " * (1 + i % 7) + f"w{i}", "", "") for i in range(120)]
    frame = spark.createDataFrame(rows, "chunk_id string, file_path string, start_line int, text string, function_name string, class_name string")
    return frame.withColumns({"project_path": F.lit("/p"), "language": F.lit("py"), "mtime_ns": F.lit(None).cast("long"), "schema_version": F.lit("1.0"), "tags": F.array(F.lit("t"))}).cache()


def test_pages_beyond_the_candidates(many):
    engine, seen = Engine(chunks=many), []
    for offset in range(0, 130, 40):
        out = engine.keyword("alpha", limit=40, offset=offset, gap=0.0)
        seen += [r["chunk_id"] for r in out.page]
        assert [r["chunk_id"] for r in out.rows.orderBy("rank").collect()] == [r["chunk_id"] for r in out.page]
    assert len(seen) == len(set(seen)) == 120
    past = engine.keyword("alpha", limit=10, offset=500, gap=0.0)
    assert past.page == [] and past.total == 120 and not past.has_more


def test_stored_words_give_the_same(many, tmp_path):
    from lodestone.operators import wordindex

    index = wordindex.write(many, str(tmp_path / "words"))
    a, b = (Engine(chunks=many, words=x).keyword("alpha w7 w90 nowhere", gap=0.0).page for x in (None, index))
    assert [(r["chunk_id"], r["keyword_rank"], r["score"]) for r in a] == [(r["chunk_id"], r["keyword_rank"], r["score"]) for r in b]
    plan = index.bm25(["alpha"])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "/docs" not in plan


def test_deep_pages(spark):
    """Far pages are those of the whole ranking, by a plan without a broadcast of the legs or a window over one partition."""
    rows = spark.range(120_000).select(F.col("id").cast("string").alias("chunk_id"), F.lit("a.md").alias("file_path"), F.concat(F.lit("alpha "), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int"))).alias("text"), F.lit("1.0").alias("schema_version"), F.lit(None).cast("long").alias("mtime_ns"))
    engine = Engine(chunks=rows)
    out = engine.keyword("alpha", limit=50, offset=110_000, gap=0.0)
    whole = retrieval.hybrid(rows, rows.select("chunk_id", F.array().cast("array<float>").alias("vector")).limit(0), "alpha", [0.0], retrieval.Filters(), 0, alpha=0.0, gap=0.0, candidates=110_050)
    want = whole.filter("rank > 110000").select("rank", "chunk_id", "keyword_rank", "score").orderBy("rank").collect()
    assert len(want) == 50 and [(r["rank"], r["chunk_id"], r["keyword_rank"], r["score"]) for r in out.page] == [tuple(r) for r in want]
    plan = retrieval.ranks(rows.select("chunk_id"), "chunk_id")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    assert engine.keyword("alpha", limit=5, offset=110_000, gap=0.0).total == 110_005


def test_terms_stand_in_for_words(tables, many):
    out = Engine(chunks=many, searchable=False).keyword("w17")
    assert [r["chunk_id"] for r in out.page] == ["k017"] and "terms" in out.warnings[0]
    both = Engine(chunks=tables[0], vectors=tables[1], embed=lambda q: [0.0, 1.0, 0.0], searchable=False).search("database", gap=0.0)
    assert both.page[0]["chunk_id"] == "c2" and both.mode == "hybrid"


def test_an_empty_index_and_other_versions(many):
    old = many.withColumn("schema_version", F.lit("0.9"))
    out = Engine(chunks=old).search("alpha")
    assert out.page == [] and out.total == 0 and out.mode == "keyword_only" and "version" in out.warnings[0]
    empty = Engine(chunks=many.limit(0)).search("alpha")
    assert empty.page == [] and empty.mode == "hybrid" and not empty.warnings


def test_explain_without_an_embedder(many):
    assert Engine(chunks=many).explain("w5", "k005").first()["rank"] == 1


def test_cache_forgets_after_an_upsert(many):
    engine = Engine(chunks=many)
    assert engine.keyword("w3", gap=0.0).total == 1
    engine.chunks = many.filter("chunk_id <> 'k003'")
    assert engine.keyword("w3", gap=0.0).total == 0
    engine.version = "2"
    assert engine.keyword("w4", gap=0.0).total == 1


def test_bm25_of_nothing(spark):
    """No rows, no rows once a join has run, no row with a word, no text, no words: no scores."""
    rows = spark.createDataFrame([("1", "alpha beta"), ("2", None), ("3", "")], "chunk_id string, text string")
    other = spark.createDataFrame([("9",)], "chunk_id string")
    for some, words in ((rows.limit(0), ["alpha"]), (rows.filter(F.lit(False)), ["alpha"]), (rows.join(other, "chunk_id"), ["alpha"]), (rows, ["gamma"]), (rows.filter("chunk_id > 1"), ["alpha"]), (rows, [])):
        assert retrieval.bm25(some, words).collect() == []
    assert [r.chunk_id for r in retrieval.bm25(rows, ["alpha", "gamma"]).collect()] == ["1"]
