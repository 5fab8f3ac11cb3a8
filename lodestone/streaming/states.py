"""The states of chunks and files as a stream of events, and the same as a batch.

An event says of a key that it was scanned with some content, taken in, failed, or
is gone.  What follows is one function of the state and the event; a batch folds it
over each key's events in their order, a stream keeps the state between its batches.
Both end in the same states, wherever the stream was stopped and started again.

That a key is gone is remembered for ``FORGET`` and then forgotten by the state store,
so what a stream holds is a row for each key there is, and not for each there ever was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.incremental import MAX_RETRIES
from lodestone.operators.keyed import Keyed

EVENTS = "key string, seq long, kind string, hash string"
STATES = "key string, seq long, status string, hash string, retry_count int"
_STATE = "seq long, status string, hash string, retry_count int"
#: Milliseconds after which an event that comes late can bring back what is gone: a week.
FORGET = 7 * 86_400_000
#: Settings of the stream: the store that such states need, and no batches without data, of which there would be no end.
_SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}

State = tuple[int, str, str | None, int]


def follow(state: State | None, seq: int, kind: str, content: str | None) -> State | None:
    """The state after an event; events at or before the last one seen, and of unknown kinds, change nothing.

    ``scan`` makes new or other content pending; ``done`` ends in embedded; ``error`` counts a try and leaves pending
    until there were ``MAX_RETRIES``, then error; ``gone`` is kept as a state, so that a late event doesn't bring it back.
    """
    if state is not None and seq <= state[0]:
        return state
    _, status, before, tries = state or (0, "gone", None, 0)
    if kind == "gone":
        return seq, "gone", None, 0
    if kind == "scan":
        return (seq, status, before, tries) if status != "gone" and before == content else (seq, "pending", content, 0)
    if status == "gone" or kind not in ("done", "error"):
        return state
    if kind == "done":
        return seq, "embedded", before, tries
    return seq, "error" if tries + 1 >= MAX_RETRIES else "pending", before, tries + 1


def folded(events: DataFrame) -> DataFrame:
    """The last state of each key of a batch of events, by built-in functions alone; keys that are gone are left out."""
    start = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("gone").alias("status"), F.lit(None).cast("string").alias("hash"), F.lit(0).alias("retry_count"))
    state = lambda e, status, content, tries: F.struct(e["seq"].alias("seq"), F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), content.alias("hash"), tries.cast("int").alias("retry_count"))

    def step(s, e):
        gone, tries = s["status"] == "gone", s["retry_count"] + 1
        nothing = F.lit(None).cast("string")
        return (
            F.when(e["seq"] <= s["seq"], s)
            .when(e["kind"] == "gone", state(e, "gone", nothing, F.lit(0)))
            .when((e["kind"] == "scan") & ~gone & s["hash"].eqNullSafe(e["hash"]), state(e, s["status"], s["hash"], s["retry_count"]))
            .when(e["kind"] == "scan", state(e, "pending", e["hash"], F.lit(0)))
            .when(gone, s)
            .when(e["kind"] == "done", state(e, "embedded", s["hash"], s["retry_count"]))
            .when(e["kind"] == "error", state(e, F.when(tries >= MAX_RETRIES, "error").otherwise("pending"), s["hash"], tries))
            .otherwise(s)
        )

    own = events.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "hash"))).alias("_e"))
    return own.select("key", F.aggregate("_e", start, step).alias("_s")).select("key", "_s.*").filter("status <> 'gone' AND seq > 0")


class _Follower(StatefulProcessor):
    """``follow`` with the states of keys that are there, and of those that are gone only their last number, for a time."""

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", _STATE)
        self.gone = handle.getValueState("gone", "seq long", self.forget)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else (self.gone.get()[0], "gone", None, 0) if self.gone.exists() else None
        events = sorted(((int(e.seq), e.kind, None if pd.isna(e.hash) else e.hash) for batch in rows for e in batch.itertuples()), key=lambda e: (e[0], e[1], e[2] is not None, e[2] or ""))
        for event in events:
            state = follow(state, *event)
        if state is None:
            return
        if state[1] == "gone":
            self.held.clear()
            self.gone.update((state[0],))
        else:
            self.gone.clear()
            self.held.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["key", "seq", "status", "hash", "retry_count"])

    def close(self) -> None:
        pass


def streamed(events: DataFrame, table: Keyed, checkpoint: str, forget: int = FORGET) -> StreamingQuery:
    """Takes what there is of a stream of events into a keyed table of ``STATES``, then stops; started again it goes on after the last batch.

    A key's events must come in their order between batches; within one they are sorted. A batch tried again writes the same rows.
    """

    def sink(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        table.change(rows.filter("status <> 'gone'"), rows.filter("status = 'gone'").select("key"))
        rows.unpersist()

    states = events.groupBy("key").transformWithStateInPandas(_Follower(forget), STATES, "Update", "ProcessingTime")
    conf = events.sparkSession.conf
    before = {name: conf.get(name) for name in _SETTINGS}
    try:
        for name, value in _SETTINGS.items():
            conf.set(name, value)
        return states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:  # a query keeps the settings that it starts with
        for name, value in before.items():
            conf.set(name, value)
