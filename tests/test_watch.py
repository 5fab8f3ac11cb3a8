"""A folder followed as a stream: only new and changed files are read, deletions are noticed, batches may be tried again."""

from __future__ import annotations

import os
import random

import pytest

from lodestone.operators import chunking
from lodestone.operators.indexer import Indexer
from lodestone.sources import files as source
from lodestone.streaming import files as watched
from lodestone.streaming.drain import hash_embedder


def _put(root, texts, at):
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
        os.utime(root / path, (at, at))


@pytest.fixture
def setting(spark, tmp_path):
    read = []

    def chunker(files):
        read.append(sorted(r.file_path for r in files.select("file_path").collect()))
        good = chunking.chunk_files(files.filter("file_path <> 'bad.md'"))
        return good.unionByName(files.filter("file_path = 'bad.md'").selectExpr("file_path", "'broken' AS error"), allowMissingColumns=True)

    root = tmp_path / "my files"
    root.mkdir()
    index = Indexer(spark, str(tmp_path / "index"), hash_embedder, chunker=chunker)
    watch = watched.Watch(spark, str(root), str(tmp_path / "state"))
    return root, index, watch, str(tmp_path / "progress"), read


def _held(index):
    return {r.file_path: r.raw_text for r in index.queue.read().collect()}


def test_only_what_changed_is_read(spark, setting):
    root, index, watch, progress, read = setting
    texts = {"a.md": "one", "b/[id] x%.md": "two", "c.md": "three", "big.md": "x" * 600_000}
    _put(root, texts, 1000)
    assert watched.follow(watch, index, progress) == 3 and read == [["a.md", "b/[id] x%.md", "c.md"]]
    assert _held(index) == {k: v for k, v in texts.items() if k != "big.md"}
    del read[:]
    assert watched.follow(watch, index, progress) == 0 and read == []
    _put(root, {"a.md": "other", "d.md": "four"}, 2000)
    (root / "c.md").unlink()
    assert watched.follow(watch, index, progress) == 3 and read == [["a.md", "d.md"]]
    assert _held(index) == {"a.md": "other", "b/[id] x%.md": "two", "d.md": "four"}
    # touched, with the same content: read, but not chunked; grown beyond the limit: as if it were gone
    del read[:]
    _put(root, {"a.md": "other", "d.md": "y" * 600_000}, 3000)
    assert watched.follow(watch, index, progress) == 2 and read == [[]]
    assert set(_held(index)) == {"a.md", "b/[id] x%.md"} and {r.file_path for r in index.vectors.read().join(index.queue.read(), "chunk_id").collect()} == set(_held(index))


class _Kept:
    """Takes files as an index does, into a dict; the second call of a round that is to fail fails after it has taken them."""

    def __init__(self):
        self.texts, self.batches, self.fail = {}, [], False

    def take(self, files, gone, priority):
        rows = files.collect()
        self.batches.append(len(rows))
        self.texts = {k: v for k, v in self.texts.items() if k not in {r.file_path for r in gone.collect()}} | {r.file_path: r.text for r in rows}
        if self.fail and len(self.batches) % 2 == 0:
            self.fail = False
            raise OSError("lost")


def test_random_changes_against_a_dict(spark, setting, monkeypatch):
    """Several listings between streams, several batches a stream, and a stream that fails on the way."""
    monkeypatch.setattr(watched, "FILES", 4)
    root, _, watch, progress, _ = setting
    rng, want, index = random.Random(3), {}, _Kept()
    for step in range(6):
        put = {f"d{rng.randrange(3)}/{rng.randrange(6)}.md": f"text {step} {rng.random()}" for _ in range(7)}
        _put(root, put, 1000 + step)
        want |= put
        for path in rng.sample(sorted(want), 2):
            (root / path).unlink()
            want.pop(path)
        assert watch.note()
        if step == 3:
            index.fail = True
            with pytest.raises(Exception, match="lost"):
                watch.streamed(index, progress).awaitTermination()
        if step % 2:
            watch.streamed(index, progress).awaitTermination()
            assert index.texts == want
    assert 1 < max(index.batches) <= 4 and not index.fail


def test_files_that_cannot_be_parsed_are_tried_three_times(spark, setting):
    root, index, watch, progress, read = setting
    _put(root, {"bad.md": "x", "good.md": "y"}, 1000)
    assert [watched.follow(watch, index, progress) for _ in range(5)] == [2, 1, 1, 0, 0]
    assert {(r.file_path, r.status, r.retry_count) for r in index.files.read().collect()} == {("bad.md", "parse_error", 3), ("good.md", "parsed", 0)}


def test_other_files_are_not_opened(spark, tmp_path):
    _put(tmp_path, {f"{i}.md": str(i) for i in range(20)}, 1000)
    rows = {r.file_path: r.location for r in source.scan(spark, str(tmp_path), locations=True).collect()}
    asked = source.scan(spark, str(tmp_path), contents=True, only=[rows["3.md"], rows["7.md"]])
    assert {r.file_path: r.text for r in asked.collect()} == {"3.md": "3", "7.md": "7"}
    assert asked.rdd.getNumPartitions() <= 2
    os.unlink(tmp_path / "3.md")
    assert [r.file_path for r in source.scan(spark, str(tmp_path), contents=True, only=[rows["3.md"], rows["7.md"]]).collect()] == ["7.md"]
    assert watched.differences(spark.createDataFrame([], watched.LISTING), spark.createDataFrame([], watched.LISTING)).count() == 0
