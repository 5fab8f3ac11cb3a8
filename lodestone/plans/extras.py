"""Queries over streams and indexes: windows, drained queues, indexed vector search."""

from __future__ import annotations

from itertools import islice

from pyspark.sql import functions as F

from lodestone.operators import ivf, pq
from lodestone.operators.scratch import gathered, place
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import QUERY_VECTOR, VECTORS_SQL, vectors
from lodestone.streaming import drain

R = Registry()


@R.add("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return drain.windowed(table(spark, sf_dir, "events"))


@R.add("i4_drained_queue", "SELECT event_id AS chunk_id, event_type || ':' || props AS raw_text, 8 AS dim FROM events WHERE event_type <> 'view'")
def i4_drained_queue(spark, sf_dir):
    """The events as a streaming queue of chunks, drained to the end and read back."""
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    queue = stream.select(F.col("event_id").alias("chunk_id"), F.concat_ws(":", "event_type", "props").alias("raw_text"), F.when(F.col("event_type") == "view", "embedded").otherwise("pending").alias("status"))
    path = place(spark, "drained")
    drain.drain(queue, path, place(spark, "progress"), drain.hash_embedder).awaitTermination()
    return drain.latest(spark, path).select("chunk_id", "raw_text", F.size("vector").alias("dim"))


_Q = ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR)


@R.add("k12_ivf_top_k", f"WITH {VECTORS_SQL} SELECT chunk_id, round(1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), [{_Q}]), 6) AS distance FROM vectors ORDER BY distance, chunk_id LIMIT 20")
def k12_ivf_top_k(spark, sf_dir):
    """The index is written by cells and searched: cells that can't hold one of the nearest rows are not opened, so the result is exact."""
    rows, centres = ivf.write(vectors(spark, sf_dir))
    return ivf.top_k(rows, centres, QUERY_VECTOR, 20).select("chunk_id", "distance")


@R.add("k12_pq_neighbors")
def k12_pq_neighbors(spark, sf_dir):
    """The ten nearest rows of each whose id is divisible by 50, from codes: whole vectors are read of 200 candidates a query. Tests measure the recall."""
    rows = vectors(spark, sf_dir)
    index = pq.VectorIndex(spark, place(spark, "vectors"))
    index.build(rows)
    asked = rows.filter("cast(chunk_id as long) % 50 = 0").orderBy(F.col("chunk_id").cast("long")).select("chunk_id", "vector")

    def answers():
        rows = asked.toLocalIterator()
        while block := list(islice(rows, pq.BLOCK)):
            names = spark.createDataFrame([(q, r["chunk_id"]) for q, r in enumerate(block)], "q int, query_id string")
            yield index.top_k([list(r["vector"]) for r in block], 10).join(F.broadcast(names), "q").select("query_id", "rank", "chunk_id", "distance")

    found = gathered(answers(), "neighbors")
    return found if found is not None else spark.createDataFrame([], "query_id string, rank int, chunk_id string, distance double")
