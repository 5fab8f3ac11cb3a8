"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm.tables import materialize
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        kept[name] = [tuple(r) for r in docs.collect()]
        if name == "near_dedup":
            own = [(r.doc_id, r.text) for r in before.collect()]
            want = {d for d, (_, c) in brute.near_duplicates(own).items() if d == c}
            assert {r[0] for r in kept[name]} == want
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
            assert not any(x[1] for x in brute.decontamination([(r[0], r[1]) for r in kept[name]], items).values())
    assert {r[0] for r in kept["mixing"]} == {r[0] for r in kept["decontamination"]}
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == len(kept["mixing"]) and out.select("shard").distinct().count() == 16


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
