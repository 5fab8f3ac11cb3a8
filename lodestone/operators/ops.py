"""Logs, queues, caches, cron, updates and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A day in seconds, the severity of errors, and how many of them a roll-up shows.
STALE_AFTER, ERROR, SHOWN = 86_400, 3, 20


def filter_log(log: DataFrame, wid: int | None = None, severity: int | None = None, kind: str | None = None, uid: int | None = None, query: str | None = None, since: int | None = None, until: int | None = None) -> DataFrame:
    """Rows that meet every given predicate; ``query`` is looked for in the message as it is stored."""
    equal = {"wid": wid, "severity": severity, "type": kind, "uid": uid}
    for name, value in equal.items():
        if value is not None:
            log = log.filter(F.col(name) == value)
    if query is not None:
        log = log.filter(F.col("message").contains(query))
    if since is not None:
        log = log.filter(F.col("timestamp") >= since)
    if until is not None:
        log = log.filter(F.col("timestamp") <= until)
    return log


def recent_log(log: DataFrame, limit: int = 50, **filters) -> DataFrame:
    return filter_log(log, **filters).orderBy(F.desc("wid")).limit(limit)


def message(template: Column, variables: Column) -> Column:
    """The template with each variable's name replaced by its value, then without tags."""
    filled = F.reduce(F.array_sort(F.map_entries(variables)), template, lambda text, v: F.replace(text, v["key"], v["value"]))
    return F.regexp_replace(filled, "(?s)<[^>]*>", "")


def queue_state(queue: DataFrame, now: int) -> DataFrame:
    """Per queue: items, the oldest's creation, how many are claimed, and the oldest's age."""
    out = queue.groupBy("name").agg(F.count("*").alias("items"), F.min("created").alias("oldest"), F.sum(F.when(F.col("expire") > 0, 1).otherwise(0)).alias("claimed"))
    return out.withColumn("age", F.coalesce(F.lit(now) - F.col("oldest"), F.lit(0).cast("long")))


def cache_state(cache: DataFrame, now: int) -> DataFrame:
    """Per bin: entries, stale ones (expiry 0 is for ever) and their share."""
    stale = (F.col("expire") != 0) & (F.col("expire") < now)
    out = cache.groupBy("bin").agg(F.count("*").alias("entries"), F.count_if(stale).alias("stale"))
    return out.withColumn("ratio", F.round(F.col("stale") / F.col("entries"), 4))


def cron_state(runs: DataFrame, now: int) -> DataFrame:
    """One row: the last run and whether it ever ran, or is over a day ago."""
    last = runs.agg(F.max("timestamp").alias("last_run"))
    return last.withColumn("status", F.when(F.col("last_run").isNull(), "NEVER_RUN").when(F.lit(now) - F.col("last_run") > STALE_AFTER, "STALE_OVER_24H").otherwise("OK"))


def pending_updates(modules: DataFrame) -> DataFrame:
    """Modules with versions (an array) over the one installed, and those versions."""
    pending = modules.withColumn("pending", F.array_sort(F.filter("versions", lambda v: v > F.col("installed"))))
    return pending.filter(F.size("pending") > 0).select("module", "installed", "pending")


def state_values(state: DataFrame, allowed: list[str], prefix: str = "system.") -> DataFrame:
    """The entries whose name is on the list or starts with the prefix."""
    return state.filter(F.col("name").isin(allowed) | F.col("name").startswith(prefix))


def failed_operations(log: DataFrame, queue: DataFrame, runs: DataFrame, modules: DataFrame, now: int) -> DataFrame:
    """(domain, subject, detail) of the latest errors, queues that stand still, cron and pending updates."""
    errors = recent_log(log, SHOWN, severity=ERROR).select(F.lit("watchdog").alias("domain"), F.col("wid").cast("string").alias("subject"), F.col("message").alias("detail"))
    queues = queue_state(queue, now).filter(F.col("age") > STALE_AFTER).select(F.lit("queue").alias("domain"), F.col("name").alias("subject"), F.col("items").cast("string").alias("detail"))
    cron = cron_state(runs, now).filter("status <> 'OK'").select(F.lit("cron").alias("domain"), F.lit("cron").alias("subject"), F.col("status").alias("detail"))
    updates = pending_updates(modules).select(F.lit("updates").alias("domain"), F.col("module").alias("subject"), F.size("pending").cast("string").alias("detail"))
    return errors.unionByName(queues).unionByName(cron).unionByName(updates)


def health(parts: DataFrame) -> DataFrame:
    """One row: WARNING if any domain has an alert, and how many it has."""
    return parts.agg(F.when(F.count("*") > 0, "WARNING").otherwise("OK").alias("health_status"), F.count("*").alias("alerts"), F.array_sort(F.collect_set("domain")).alias("domains"))
