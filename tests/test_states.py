"""States of chunks: the stream, stopped and started again, against the batch and a plain loop."""

from __future__ import annotations

import random

from lodestone.operators.keyed import Keyed
from lodestone.streaming import states


def _events(n, seed):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(30)}", seq, rng.choice(["scan", "scan", "done", "error", "error", "gone", "other"]), rng.choice(["a", "b", None])) for seq in range(1, n)]


def test_follow():
    after = lambda *events: states.follow(after(*events[:-1]), len(events), *events[-1]) if events else None
    scan, done, error, gone = ("scan", "a"), ("done", None), ("error", None), ("gone", None)
    assert after(scan, done)[1:] == ("embedded", "a", 0) and after(done) is None
    assert after(scan, error, error)[1:] == ("pending", "a", 2) and after(scan, error, error, error)[1:] == ("error", "a", 3)
    assert after(scan, error, error, error, scan)[1] == "error" and after(scan, error, ("scan", "b"))[1:] == ("pending", "b", 0)
    assert after(scan, done, gone, done)[1] == "gone" and after(scan, gone, scan)[1:] == ("pending", "a", 0)
    assert states.follow((5, "embedded", "a", 0), 5, "gone", None)[1] == "embedded"


def test_a_stream_ends_as_the_batch(spark, tmp_path):
    events, want = _events(400, 1), {}
    for key, seq, kind, content in events:
        want[key] = states.follow(want.get(key), seq, kind, content)
    want = {k: s for k, s in want.items() if s and s[1] != "gone"}
    rows = spark.createDataFrame(events, states.EVENTS)
    assert {r.key: (r.seq, r.status, r.hash, r.retry_count) for r in states.folded(rows).collect()} == want and len({s[1] for s in want.values()}) == 3
    source = str(tmp_path / "events")
    table = Keyed(spark, str(tmp_path / "states"), states.STATES, ["key"], buckets=2)
    for a, b in ((0, 150), (150, 151), (151, 399)):  # the stream is stopped after each part and started again
        spark.createDataFrame(events[a:b], states.EVENTS).coalesce(1).write.mode("append").parquet(source)
        states.streamed(spark.readStream.schema(states.EVENTS).parquet(source), table, str(tmp_path / "progress")).awaitTermination()
    assert {r.key: (r.seq, r.status, r.hash, r.retry_count) for r in table.read().collect()} == want
    assert states.folded(rows.limit(0)).count() == 0


def test_what_is_gone_is_forgotten_in_time(spark, tmp_path):
    """A late event finds a key gone, or after the time unknown; keys that are there stay, and the session keeps its settings."""
    before = {name: spark.conf.get(name) for name in states._SETTINGS}
    for name, forget, want in (("long", states.FORGET, {"b"}), ("short", 1, {"a", "b"})):
        source, progress = str(tmp_path / name), str(tmp_path / f"{name}-progress")
        table = Keyed(spark, str(tmp_path / f"{name}-states"), states.STATES, ["key"], buckets=2)
        for events in ([("a", 5, "scan", "x"), ("a", 6, "gone", None), ("b", 7, "scan", "y")], [("a", 3, "scan", "x"), ("b", 4, "gone", None)]):
            spark.createDataFrame(events, states.EVENTS).coalesce(1).write.mode("append").parquet(source)
            states.streamed(spark.readStream.schema(states.EVENTS).parquet(source), table, progress, forget).awaitTermination()
        assert {r.key for r in table.read().collect()} == want
    assert {name: spark.conf.get(name) for name in states._SETTINGS} == before != states._SETTINGS
