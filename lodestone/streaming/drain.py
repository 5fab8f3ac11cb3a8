"""Queues drained as streams: batches written once, however often they are tried; windows over late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def embed_sink(path: str, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: embeds a batch and writes it under its number, so a batch that is tried again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        embed(batch.dropDuplicates(["chunk_id"])).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def drain(queue: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Takes what is pending in a streaming queue, then stops; started again it goes on after the last batch done."""
    return queue.filter("status = 'pending'").writeStream.foreachBatch(embed_sink(path, embed)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """What was written, each key from its last batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy(key).agg(F.max("batch").alias("batch"))
    return rows.join(last, [key, "batch"], "left_semi").drop("batch")


def windowed(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) per window, for batches and, with a watermark, for streams. An addition of this library."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def hash_embedder(rows: DataFrame, dim: int = 8) -> DataFrame:
    """Deterministic vectors from a hash of the text, for tests and dry runs."""
    parts = [((F.xxhash64("raw_text", F.lit(i)) % 1000) / 1000.0).cast("float") for i in range(dim)]
    return rows.select("chunk_id", "raw_text", F.array(*parts).alias("vector"))
