"""What a task holds doesn't grow with the number of blocks of queries, or with the rows of one row group."""

import itertools
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import pq, snapshots, wordindex
from lodestone.operators.scratch import place
from lodestone.plans import lookups, operations, texts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_answers_of_many_blocks_are_one_scan(spark, monkeypatch):
    rows = spark.createDataFrame([(str(i), [float((i * p) % 31 - 15) for p in (3, 5, 7, 11)]) for i in range(200)], "chunk_id string, vector array<double>")
    index = pq.VectorIndex(spark, place(spark, "vectors"))
    index.build(rows)
    asked = [list(r.vector) for r in rows.limit(9).collect()]
    own = {(q, *x) for q in range(9) for x in ((r.rank, r.chunk_id, r.distance) for r in index.top_k([asked[q]], 3).collect())}
    monkeypatch.setattr(pq, "BLOCK", 4)
    found = index.top_k(asked, 3)
    assert {tuple(r) for r in found.collect()} == own
    assert "Union" not in _plan(found) and "Window" not in _plan(found)


def test_tables_of_one_row_group_are_spread(spark):
    folder = "/root/testdata/sf0.01"
    for made in (lookups._asked(spark, folder), texts._php(spark, folder), operations._objects(spark, folder)):
        assert "REPARTITION_BY_NUM" in _plan(made)
    pairs = spark.createDataFrame([("a", ["b", "c", "b"]), ("b", ["c", "d"]), ("a", ["b"]), ("e", [])], "name string, depends_on array<string>")
    plan = _plan(snapshots.dependents(pairs))
    assert re.search(r"REPARTITION_BY_NUM", plan) and not re.search(r"Exchange hashpartitioning\([^)]*\), ENSURE_REQUIREMENTS", plan)
    got = sorted(tuple(r) for r in snapshots.dependents(pairs, depth=2).collect())
    assert got == [("b", "a", 1), ("c", "a", 1), ("c", "b", 1), ("d", "a", 2), ("d", "b", 1)]


def test_keywords_of_a_column(spark):
    asked = ["the getPart of Is_It a.b IS \"is it\" is x", "", "The THE the", "it's \"to\" be", "v1.2 ABC-1 is ABC"]
    rows = spark.createDataFrame([(q,) for q in [*asked, None]], "q string").select("q", t.keywords_of(F.col("q")).alias("k")).collect()
    assert [(r.q, r.k) for r in rows] == [*((q, t.keywords(q)) for q in asked), (None, None)]


def test_words_of_a_text_are_counted_once_and_shuffled_once(spark, tmp_path, monkeypatch):
    read, plans = spark.sparkContext.accumulator(0), []

    @F.udf("string")
    def text_of(i):
        read.add(1)
        return f"w{i % 7} the the W{i % 3}"

    whole = type(spark.range(1)).sortWithinPartitions
    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", lambda self, *by: plans.append(_plan(whole(self, *by))) or whole(self, *by))
    index = wordindex.write(spark.range(0, 500, 1, 4).select(F.col("id").cast("string").alias("chunk_id"), text_of("id").alias("text")), str(tmp_path / "words"))
    assert read.value == 500 and plans[-1].count("Exchange") == 1
    assert index.counts() == (500, 2000, 1) and index.folder.names("segment=1") == ["docs", "postings"]


def test_blocks_of_runs_that_pass_batches(monkeypatch):
    rng = random.Random(3)
    rows = sorted((rng.choice("abc"), rng.randrange(4), f"c{i}", rng.randrange(1, 9), rng.randrange(1, 99)) for i in range(200))
    want = [(0, *k, len(v), max(x[3] for x in v), min(x[4] for x in v), *([x[c] for x in v] for c in (2, 3, 4))) for k, v in ((k, list(v)) for k, v in itertools.groupby(rows, lambda x: x[:2]))]
    whole = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * 200, pa.int32()), **dict(zip(("term", "range", "chunk_id", "tf", "n"), map(list, zip(*rows)), strict=True))})
    for size in (1, 7, 60, 200):
        parts = [whole.slice(0, 0), *(whole.slice(i, size) for i in range(0, 200, size))]
        assert [tuple(x.values()) for out in wordindex._blocked(iter(parts)) for x in out.to_pylist()] == want
    assert list(wordindex._blocked(iter([]))) == []


def test_words_of_bytes_are_those_of_tokens(spark, monkeypatch):
    texts_ = ["The a.b_c-the", "", None, "K1 İstanbul été naïve", "x" * 50 + " y\n" * 40 + "\x00z\x7f", "...", " \t ", "café.md中文v1.2 \U0001f600ok"]
    rows = spark.createDataFrame(list(enumerate(texts_)), "i int, text string")
    low = F.lower(F.coalesce("text", F.lit("")))
    for piece in (3, 1 << 20):
        monkeypatch.setattr(wordindex, "PIECE", piece)
        for r in rows.select(low.alias("low"), t.tokens(F.coalesce("text", F.lit(""))).alias("t")).collect():
            assert wordindex._occurrences(r.low.encode()) == Counter(x.encode() for x in r.t)
