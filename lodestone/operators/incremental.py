"""Change detection, idempotent upserts, and the states of files and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How often a file is parsed again, the day in nanoseconds under which a file is fresh.
MAX_RETRIES, FRESH_NS = 3, 86_400_000_000_000


def changes(scanned: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, state) of files (file_path, size, mtime_ns, hash) against what is stored (and status).

    Equal size and time, or an equal hash, leave a file up to date, if its last
    run came to an end; a file no longer scanned is deleted.
    """
    old = stored.select("file_path", F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("hash").alias("_hash"), F.col("status").alias("_status"), F.lit(True).alias("_old"))
    rows = scanned.withColumn("_new", F.lit(True)).join(old, "file_path", "full_outer")
    same = ((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))) | (F.col("hash") == F.col("_hash"))
    done = F.col("_status").isin("parsed", "up_to_date")
    state = F.when(F.col("_new").isNull(), "deleted").when(F.col("_old").isNull(), "new").when(F.lit(not force) & F.coalesce(same, F.lit(False)) & done, "up_to_date").otherwise("pending_parse")
    return rows.select("file_path", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None, distinct: bool = False) -> DataFrame:
    """The rows of both, of a key in both the new one. Doing it again changes nothing.

    Of a key several times in ``new`` the row greatest in the columns ``order``, then in all columns, is taken;
    where the caller knows that there is none (``distinct``), rows aren't compared or shuffled for it.
    """
    if distinct:
        return old.join(new.select(*key), key, "left_anti").unionByName(new)
    named = [*(order or []), *(c for c in new.columns if c not in (order or []))]
    fresh = new.groupBy(*key).agg(F.max(F.struct(*named)).alias("_new")).select(*(F.col(f"_new.{c}").alias(c) for c in new.columns))
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def requeue(queue: DataFrame, incoming: DataFrame, now: int) -> DataFrame:
    """The queue with incoming chunks pending: what a chunk already has of created_at and retry_count it keeps."""
    a = queue.select("chunk_id", *(F.col(c).alias(f"_{c}") for c in ("raw_text", "status", "priority", "created_at", "retry_count")), F.lit(True).alias("_old"))
    b = incoming.select("chunk_id", "raw_text", "priority", F.lit(True).alias("_in"))
    rows = a.join(b, "chunk_id", "full_outer")
    came = F.col("_in").isNotNull()
    pick = lambda new, c: F.when(came, new).otherwise(F.col(f"_{c}")).alias(c)
    return rows.select("chunk_id", pick(F.col("raw_text"), "raw_text"), pick(F.lit("pending"), "status"), pick(F.col("priority"), "priority"), F.coalesce("_created_at", F.lit(now)).alias("created_at"), F.coalesce("_retry_count", F.lit(0)).alias("retry_count"))


def next_batch(queue: DataFrame, n: int) -> DataFrame:
    """The n pending chunks to take next: by priority, then age, then id."""
    return queue.filter("status = 'pending'").orderBy(F.desc("priority"), "created_at", "chunk_id").limit(n)


def mark(queue: DataFrame, done: DataFrame, status: str) -> DataFrame:
    """The queue with the chunks in ``done`` (chunk_id) in a new state; an error counts one more try."""
    hit = queue.join(done.select("chunk_id").distinct().withColumn("_hit", F.lit(True)), "chunk_id", "left")
    out = hit.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status")))
    if status == "error":
        out = out.withColumn("retry_count", F.col("retry_count") + F.when(F.col("_hit"), 1).otherwise(0))
    return out.drop("_hit")


def outdated(queue: DataFrame, states: DataFrame) -> DataFrame:
    """The queue with the chunks of changed files (file_path, state) stale; ``requeue`` makes those that come again pending."""
    changed = states.filter("state = 'pending_parse'").select("file_path").distinct().withColumn("_hit", F.lit(True))
    hit = queue.join(changed, "file_path", "left")
    return hit.withColumn("status", F.when(F.col("_hit"), "stale").otherwise(F.col("status"))).select(*queue.columns)


def retryable(files: DataFrame) -> DataFrame:
    return files.filter(F.col("status").isin("pending_parse", "error") & (F.col("retry_count") < MAX_RETRIES))


def priority(run: int, mtime_ns: Column, now_ns: int) -> Column:
    """3 for a run of the highest kind, 2 for a file changed within a day, else the run's."""
    if run == 3:
        return F.lit(3)
    return F.when(F.lit(now_ns) - mtime_ns < FRESH_NS, 2).otherwise(run)


def progress(queue: DataFrame, elapsed: float) -> DataFrame:
    """One row: done, total, percent (one decimal, 100 at most), rate a second (after five seconds) and seconds to go (-1: unknown)."""
    counts = queue.agg(F.count_if(F.col("status") == "embedded").alias("done"), F.count_if(F.col("status").isin("embedded", "pending")).alias("total"))
    percent = F.when(F.col("total") > 0, F.least(F.round(100 * F.col("done") / F.col("total"), 1), F.lit(100.0))).otherwise(0.0)
    rate = F.when(F.lit(elapsed > 5), F.round(F.col("done") / F.lit(elapsed), 4)).otherwise(0.0)
    out = counts.withColumn("percent", percent).withColumn("rate", rate)
    return out.withColumn("eta", F.when(F.col("rate") > 0, F.ceil((F.col("total") - F.col("done")) / F.col("rate"))).otherwise(-1).cast("long"))


def current(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Of each key the row with the greatest version, on equal ones the greatest in all columns; combined before the shuffle."""
    named = [version, *(c for c in rows.columns if c != version)]
    best = rows.groupBy(*key).agg(F.max(F.struct(*named)).alias("_best"))
    return best.select(*(F.col(f"_best.{c}").alias(c) for c in rows.columns))
