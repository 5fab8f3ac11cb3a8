"""Connected components of a graph given as edges, with joins and grouped minima only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.llm.tables import Owned, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each end of the edges (a, b): component is the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes; each step is
    a grouped minimum, combined before the shuffle and written, and a join straight
    on shuffled rows, which adaptive execution can split: a node with very many
    neighbours is no single task.
    Self-loops and repeated edges are harmless; null ends are dropped.
    """
    with Owned() as own:
        now = _starred(edges)
        own.keep(now)
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node")))


def _starred(edges: DataFrame) -> DataFrame:
    """The written edges (a, b) from each node to the smallest of its component."""
    now, state = _settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "low")
        large = both.join(low, "a").filter("b > a and b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before = state
        now, state = _settled(small)
        if state == before:
            return now


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The distinct edges from larger to smaller ends, written, and their count and checksum."""
    seen = Observation()
    count, checksum = F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("sum")
    out = materialize(edges.filter("a > b").distinct().observe(seen, count, checksum), "edges")
    return out, tuple(seen.get.values())
