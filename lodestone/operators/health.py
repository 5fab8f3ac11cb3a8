"""Checks that an index and its queue agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# How far two counts may lie apart, the share of rows of another version that is warned of, and when an index is rebuilt.
LEAST_GAP, GAP_SHARE, FAR, MISMATCH, REBUILD = 10, 0.05, 10, 0.1, 5000


def status(queue: DataFrame, files: DataFrame) -> DataFrame:
    """One row: pending and embedded chunks, files and the latest time one was indexed."""
    a = queue.agg(F.coalesce(F.sum(F.when(F.col("status") == "pending", 1).otherwise(0)), F.lit(0)).alias("pending"), F.coalesce(F.sum(F.when(F.col("status") == "embedded", 1).otherwise(0)), F.lit(0)).alias("embedded"))
    b = files.agg(F.count("*").alias("files"), F.max("indexed_at").alias("last_indexed"))
    return a.join(b, F.lit(True))  # one row each


def missing_vectors(queue: DataFrame, vectors: DataFrame) -> DataFrame:
    """Embedded chunks without a vector: all of them, not a sample."""
    return queue.filter("status = 'embedded'").select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti")


def extra_vectors(queue: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors of chunks that aren't embedded."""
    return vectors.select("chunk_id").join(queue.filter("status = 'embedded'").select("chunk_id"), "chunk_id", "left_anti")


def counts_agree(queue: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: both counts and ok, warning or error (over ten times apart)."""
    a, b = queue.filter("status = 'embedded'").agg(F.count("*").alias("queued")), vectors.agg(F.count("*").alias("stored"))
    rows = a.join(b, F.lit(True))  # one row each
    most, least = F.greatest("queued", "stored"), F.least("queued", "stored")
    close = most - least <= F.greatest(F.lit(LEAST_GAP), F.floor(F.lit(GAP_SHARE) * most))
    return rows.withColumn("level", F.when(close, "ok").when(most > FAR * F.greatest(least, F.lit(1)), "error").otherwise("warning"))


def versions(chunks: DataFrame, current: str) -> DataFrame:
    """One row: rows, those of the current version, those without one, and the share that doesn't match (six decimals)."""
    v = F.col("schema_version")
    out = chunks.agg(F.count("*").alias("declared"), F.count_if(v == current).alias("compatible"), F.count_if(v.isNull() | v.isin("", "unknown")).alias("unversioned"))
    share = F.when(F.col("declared") > 0, F.greatest(F.lit(0.0), F.round((F.col("declared") - F.col("compatible")) / F.col("declared"), 6))).otherwise(0.0)
    return out.withColumn("stale_ratio", share).withColumn("warn", F.col("stale_ratio") > MISMATCH)


def stale_files(stored: DataFrame, present: DataFrame) -> DataFrame:
    """Files of the index that are gone."""
    return stored.select("file_path").distinct().join(present.select("file_path"), "file_path", "left_anti")


def backfilled(chunks: DataFrame, current: str) -> DataFrame:
    """The chunks with the current version where there was none, and those embedded then pending again."""
    none = F.col("schema_version").isNull() | F.col("schema_version").isin("", "unknown")
    return chunks.withColumn("status", F.when(none & (F.col("status") == "embedded"), "pending").otherwise(F.col("status"))).withColumn("schema_version", F.when(none, current).otherwise(F.col("schema_version")))
