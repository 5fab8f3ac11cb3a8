"""Runs of an index: who holds it, which are stuck, and repairs of what they left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUNS = "run_id string, status string, started_at long, updated_at long"
# Seconds after which a silent run no longer holds the index, and after which it counts as stuck.
LOCK_SECONDS, STUCK_SECONDS = 600, 600


def holders(runs: DataFrame, now: int, seconds: int = LOCK_SECONDS) -> DataFrame:
    """Running runs that were heard of within so many seconds: nobody else may write."""
    return runs.filter((F.col("status") == "running") & (F.lit(now) - F.col("updated_at") < seconds))


def stuck(runs: DataFrame, now: int, seconds: int = STUCK_SECONDS) -> DataFrame:
    """Running runs that were not heard of for so many seconds, and for how long."""
    silent = F.lit(now) - F.col("updated_at")
    return runs.filter((F.col("status") == "running") & (silent >= seconds)).withColumn("silent", silent)


def fingerprints(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: files stored, those that differ from what was scanned, and those that are gone; all files, not a sample."""
    now = scanned.select("file_path", F.col("hash").alias("_now"), F.lit(True).alias("_there"))
    rows = stored.join(now, "file_path", "left")
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("_there") & ~F.col("hash").eqNullSafe(F.col("_now"))).alias("changed"), F.count_if(F.col("_there").isNull()).alias("gone"))


def repended(queue: DataFrame, missing: DataFrame) -> DataFrame:
    """The queue with embedded chunks that have no vector (missing: chunk_id) pending again."""
    hit = queue.join(missing.select("chunk_id").distinct().withColumn("_hit", F.lit(True)), "chunk_id", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status"))).select(*queue.columns)


def retried(queue: DataFrame) -> DataFrame:
    """The queue with errors pending again, their tries forgotten."""
    error = F.col("status") == "error"
    return queue.withColumn("retry_count", F.when(error, 0).otherwise(F.col("retry_count"))).withColumn("status", F.when(error, "pending").otherwise(F.col("status")))


def without_files(rows: DataFrame, stale: DataFrame) -> DataFrame:
    """Rows of files that are still there."""
    return rows.join(stale.select("file_path"), "file_path", "left_anti").select(*rows.columns)
