"""What is written grows with the input: repeated ids, texts on one template, rows without ids; and columns of any names."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, minhash, mixing, substrings, tables, toxicity
from tests.llm import brute


def _words(rng, n):
    return " ".join(f"{rng.randrange(1 << 24):06x}" for _ in range(n))


def _family(n, fixed, slot):
    """Texts of four fixed passages and four slots, each filled from eight variants."""
    rng = random.Random(1)
    parts, variants = [_words(rng, fixed) for _ in range(4)], [[_words(rng, slot) for _ in range(8)] for _ in range(4)]
    return [(k, " ".join(f"{parts[i]} {rng.choice(variants[i])}" for i in range(4))) for k in range(n)]


@pytest.mark.parametrize(("fixed", "slot"), [(25, 4), (15, 15)])
def test_texts_on_a_template(spark, monkeypatch, fixed, slot):
    written = {}

    def counted(df, name):
        out = tables.materialize(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    rows = []
    for n in (400, 800):
        written.clear()
        texts = _family(n, fixed, slot)
        got = minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
        rows.append(sum(written.values()))
        if n == 400:
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(texts)
    assert rows[1] <= 2.4 * rows[0]


def test_one_id_in_many_rows(spark, monkeypatch):
    """The list of what stands earlier is bounded by one text, however many rows share an id."""
    rng = random.Random(3)
    text = _words(rng, 300)
    lists = []
    real = substrings._listed
    for n in (50, 200):
        docs = spark.createDataFrame([(1, text)] + [(7, text)] * n, "doc_id long, text string").repartition(3)
        whole, single = substrings.repeated(docs)
        found = whole.select("doc_id", "extent").distinct().count(), single.distinct().count()
        lists.append(found)
        got = substrings.remove_repeats(docs).collect()
        assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0)] + [(7, 300)] * n
    assert lists[0] == lists[1] and real is substrings._listed


def test_rows_without_ids_are_spread(spark):
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    sizes = rows.select("doc_id", F.lit("s:a").alias("_src"), mixing.tokens(F.col("text")).alias("_tokens"), mixing._checksum(F.col("text")).alias("_hash"), F.lit(0).alias("_epoch"))
    most, n = mixing._spread(sizes, 64, "seed").groupBy("_bucket").count().agg(F.max("count"), F.count("*")).first()
    assert n == 64 and most < 2 * 20_000 / 64
    assert mixing.sequence(rows).count() == 20_000


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "_c1", "_c4", "we`ird", "SCORE", "_x3", "_kept0", "Weight", "a b", "bands"]


def test_any_column_names(spark):
    rng = random.Random(5)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    items = [(1, _words(rng, 12)), (2, _words(rng, 8))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(k, _words(rng, 30) + (f" {items[0][1]} x" if k % 7 == 0 else ""), "en", f"s{k % 3}", 9, *(f"{n}{k}" for n in NAMES[5:])) for k in range(40)]
    docs = spark.createDataFrame([(*r[:5], *r[5:]) for r in rows], ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in zip(NAMES, ["long", "string", "string", "string", "long"] + ["string"] * 10, strict=True)))
    own = {r[0]: r[5:] for r in rows}
    for stage in (lambda d: toxicity.drop_toxic(d, labels), minhash.keep_one, lambda d: decontamination.remove(d, benchmark), mixing.mixed):
        out = stage(docs)
        assert out.columns == NAMES
        for r in out.collect():
            assert tuple(r[5:]) == own[r[0]]
    sharded = corpus_pipeline.shard(spark, docs, "")
    assert sharded.count() == 40 and set(NAMES) - {"n_chars"} <= set(sharded.columns)
    kept = mixing.sequence(docs, keep=["Weight", "a.b", "text"])
    assert kept.columns[-3:] == ["_Weight", "a.b", "text"]


def test_what_a_block_writes_goes(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "shared_dir", lambda _: str(tmp_path))
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir())
    with tables.Owned() as outer:
        with tables.Owned() as inner:
            a, b = tables.materialize(spark.range(3), "a"), tables.materialize(spark.range(2), "b")
            inner.keep(a)
        assert left() == ["a"] and a.count() == 3
        c = tables.materialize(a, "c")
        outer.keep(c)
    assert left() == ["c"] and c.count() == 3 and b is not None
    docs = spark.createDataFrame(_family(60, 25, 4), "doc_id long, text string")
    kept = minhash.keep_one(docs)
    assert left() == ["c", "kept"] and kept.count() >= 1
    found = minhash.near_duplicates(docs)
    assert left() == ["c", "kept", "named", "sketches"] and found.count() == 60
