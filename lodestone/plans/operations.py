"""Operations, snapshots and incremental queries over events, orders, parts and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import incremental as inc
from lodestone.operators import ops, runs, snapshots
from lodestone.functions import dates
from lodestone.operators.scratch import spread
from lodestone.plans.base import Registry, table

R = Registry()
NOW = 1_706_659_200

_LOG_SQL = "log AS (SELECT event_id AS wid, event_type AS type, user_id AS uid, event_id % 8 AS severity, CAST(floor(epoch(ts)) AS BIGINT) AS timestamp, '<b>@type</b> by %user: ' || props AS message, event_type, value FROM events)"
_QUEUE_SQL = "queue AS (SELECT event_type || '_' || user_id % 4 AS name, CAST(floor(epoch(ts)) AS BIGINT) AS created, CASE WHEN event_id % 5 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 60 ELSE 0 END AS expire FROM events)"
_CACHE_SQL = f"cache AS (SELECT event_type AS bin, CASE WHEN event_id % 3 = 0 THEN 0 ELSE CAST(floor(epoch(ts)) AS BIGINT) + event_id * 1000 END AS expire FROM events)"
_MODULES_SQL = "modules AS (SELECT p_name || p_partkey AS module, CAST(p_size AS BIGINT) AS installed, [CAST(p_partkey % 60 AS BIGINT), CAST(p_partkey % 45 AS BIGINT), CAST(p_partkey % 30 AS BIGINT)] AS versions FROM part)"


def log(spark, sf_dir):
    """events as a site's log."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("wid"), F.col("event_type").alias("type"), F.col("user_id").alias("uid"), (F.col("event_id") % 8).alias("severity"), F.unix_timestamp("ts").alias("timestamp"), F.concat(F.lit("<b>@type</b> by %user: "), "props").alias("message"), "event_type", "value")


def queue(spark, sf_dir):
    created = F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("_"), (F.col("user_id") % 4).cast("string")).alias("name"), created.alias("created"), F.when(F.col("event_id") % 5 == 0, created + 60).otherwise(0).alias("expire"))


def cache(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("bin"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.unix_timestamp("ts") + F.col("event_id") * 1000).alias("expire"))


def modules(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.concat("p_name", k.cast("string")).alias("module"), F.col("p_size").cast("long").alias("installed"), F.array(k % 60, k % 45, k % 30).alias("versions"))


@R.add("q14_log_filter", f"WITH {_LOG_SQL} SELECT wid, type, uid, severity, timestamp FROM log WHERE severity = 3 AND type = 'error' AND contains(message, '7') AND timestamp >= 1704500000 AND timestamp <= 1706000000")
def q14_log_filter(spark, sf_dir):
    return ops.filter_log(log(spark, sf_dir), severity=3, kind="error", query="7", since=1_704_500_000, until=1_706_000_000).select("wid", "type", "uid", "severity", "timestamp")


@R.add("o6_log_top_k", f"WITH {_LOG_SQL} SELECT wid, type, severity FROM log WHERE severity = 0 ORDER BY wid DESC LIMIT 50")
def o6_log_top_k(spark, sf_dir):
    return ops.recent_log(log(spark, sf_dir), severity=0).select("wid", "type", "severity")


@R.add("t_log_messages", f"WITH {_LOG_SQL} SELECT wid, regexp_replace(replace(replace(message, '%user', CAST(uid AS VARCHAR)), '@type', type), '<[^>]*>', '', 'gs') AS message FROM log")
def t_log_messages(spark, sf_dir):
    rows = log(spark, sf_dir)
    return rows.select("wid", ops.message(F.col("message"), F.create_map(F.lit("@type"), F.col("type"), F.lit("%user"), F.col("uid").cast("string"))).alias("message"))


@R.add("a5_queue_state", f"WITH {_QUEUE_SQL} SELECT name, count(*) AS items, min(created) AS oldest, CAST(sum(CASE WHEN expire > 0 THEN 1 ELSE 0 END) AS BIGINT) AS claimed, {NOW} - min(created) AS age FROM queue GROUP BY name")
def a5_queue_state(spark, sf_dir):
    return ops.queue_state(queue(spark, sf_dir), NOW)


@R.add("a6_cache_state", f"WITH {_CACHE_SQL} SELECT bin, count(*) AS entries, count(*) FILTER (expire <> 0 AND expire < {NOW}) AS stale, round(count(*) FILTER (expire <> 0 AND expire < {NOW}) / count(*), 4) AS ratio FROM cache GROUP BY bin")
def a6_cache_state(spark, sf_dir):
    return ops.cache_state(cache(spark, sf_dir), NOW)


@R.add("cron_state", f"WITH {_LOG_SQL} SELECT max(timestamp) AS last_run, CASE WHEN max(timestamp) IS NULL THEN 'NEVER_RUN' WHEN {NOW} - max(timestamp) > 86400 THEN 'STALE_OVER_24H' ELSE 'OK' END AS status FROM log WHERE type = 'signup'")
def cron_state(spark, sf_dir):
    return ops.cron_state(log(spark, sf_dir).filter("type = 'signup'"), NOW)


@R.add("pending_updates", f"WITH {_MODULES_SQL} SELECT module, installed, list_sort(list_filter(versions, lambda v: v > installed)) AS pending FROM modules WHERE len(list_filter(versions, lambda v: v > installed)) > 0")
def pending_updates(spark, sf_dir):
    return ops.pending_updates(modules(spark, sf_dir))


@R.add("q15_state_values", "SELECT p_name AS name, count(*) AS n FROM part WHERE p_name IN ('cold widget', 'hot bolt') OR starts_with(p_name, 'large') GROUP BY p_name")
def q15_state_values(spark, sf_dir):
    return ops.state_values(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name"), ["cold widget", "hot bolt"], "large").groupBy("name").agg(F.count("*").alias("n"))


_FAILED = f"""{_LOG_SQL}, {_QUEUE_SQL}, {_MODULES_SQL}, failed AS (
  SELECT 'watchdog' AS domain, CAST(wid AS VARCHAR) AS subject, message AS detail FROM (SELECT * FROM log WHERE severity = 3 ORDER BY wid DESC LIMIT 20)
  UNION ALL SELECT 'queue', name, CAST(count(*) AS VARCHAR) FROM queue GROUP BY name HAVING {NOW} - min(created) > 86400
  UNION ALL SELECT 'cron', 'cron', CASE WHEN max(timestamp) IS NULL THEN 'NEVER_RUN' ELSE 'STALE_OVER_24H' END FROM log WHERE type = 'signup' HAVING max(timestamp) IS NULL OR {NOW} - max(timestamp) > 86400
  UNION ALL SELECT 'updates', module, CAST(len(list_filter(versions, lambda v: v > installed)) AS VARCHAR) FROM modules WHERE len(list_filter(versions, lambda v: v > installed)) > 0)"""


def _failed(spark, sf_dir):
    rows = log(spark, sf_dir)
    return ops.failed_operations(rows, queue(spark, sf_dir), rows.filter("type = 'signup'"), modules(spark, sf_dir), NOW)


@R.add("a14_failed_operations", f"WITH {_FAILED} SELECT * FROM failed")
def a14_failed_operations(spark, sf_dir):
    return _failed(spark, sf_dir)


@R.add("a15_runtime_health", f"WITH {_FAILED} SELECT CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'OK' END AS health_status, count(*) AS alerts, list_sort(list_distinct(list(domain))) AS domains FROM failed")
def a15_runtime_health(spark, sf_dir):
    return ops.health(_failed(spark, sf_dir))


# --- snapshots ---------------------------------------------------------------

_NAME = "CASE WHEN {k} % 11 = 0 THEN 'field.storage.' WHEN {k} % 7 = 0 THEN 'views.view.' WHEN {k} % 5 = 0 THEN 'node.type.' WHEN {k} = 1 THEN 'core.extension' ELSE 'system.' END || CASE WHEN {k} = 1 THEN '' ELSE CAST({k} AS VARCHAR) END"
_SNAP_SQL = f"""active AS (SELECT {_NAME.format(k='p_partkey')} AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, p_type AS deps FROM part WHERE p_size <> 13),
sync AS (SELECT {_NAME.format(k='p_partkey')} AS name, p_brand AS brand, CAST(CASE WHEN p_partkey % 9 = 0 THEN p_size + 1 ELSE p_size END AS VARCHAR) AS size, CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type END AS deps FROM part WHERE p_size <> 17),
diffed AS (
  SELECT name, CASE WHEN a.brand IS NULL THEN 'added' WHEN b.brand IS NULL THEN 'removed' WHEN len(keys) = 0 THEN 'identical' ELSE 'changed' END AS status, keys AS changed_keys
  FROM (SELECT coalesce(a.name, b.name) AS name, a, b, list_filter([CASE WHEN a.brand IS DISTINCT FROM b.brand THEN 'brand' END, CASE WHEN a.deps IS DISTINCT FROM b.deps THEN 'dependencies' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END], lambda x: x IS NOT NULL) AS keys
        FROM active a FULL OUTER JOIN sync b ON a.name = b.name)
), rated AS (
  SELECT *, CASE WHEN status = 'removed' THEN 'high' WHEN status = 'added' THEN 'low' WHEN name IN ('system.site', 'core.extension') OR starts_with(name, 'field.storage.') OR starts_with(name, 'node.type.') THEN 'high' WHEN list_contains(changed_keys, 'dependencies') THEN 'medium' ELSE 'low' END AS risk_level FROM diffed
)"""


def _name(k):
    prefix = F.when(k % 11 == 0, "field.storage.").when(k % 7 == 0, "views.view.").when(k % 5 == 0, "node.type.").when(k == 1, "core.extension").otherwise("system.")
    return F.concat(prefix, F.when(k == 1, "").otherwise(k.cast("string")))


def _snapshots(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    pack = lambda size, deps: F.map_filter(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), size.cast("string"), F.lit("dependencies"), deps), lambda _, v: v.isNotNull())
    active = part.filter("p_size <> 13").select(_name(k).alias("name"), pack(F.col("p_size"), F.col("p_type")).alias("data"))
    sync = part.filter("p_size <> 17").select(_name(k).alias("name"), pack(F.when(k % 9 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")), F.when(k % 8 != 0, F.col("p_type"))).alias("data"))
    return active, sync


@R.add("n16_snapshot_diff", f"WITH {_SNAP_SQL} SELECT * FROM rated")
def n16_snapshot_diff(spark, sf_dir):
    return snapshots.diff(*_snapshots(spark, sf_dir))


@R.add("q16_config_drift", f"WITH {_SNAP_SQL} SELECT name, status FROM rated WHERE starts_with(name, 'field.') AND status <> 'identical'")
def q16_config_drift(spark, sf_dir):
    return snapshots.drift(snapshots.diff(*_snapshots(spark, sf_dir)), "field.").select("name", "status")


_NEEDS_SQL = "needs AS (SELECT DISTINCT 'part' || l_partkey AS name, 'supp' || l_suppkey AS required_by FROM lineitem UNION SELECT DISTINCT 'supp' || s_suppkey, 'nation' || s_nationkey FROM supplier)"


def _objects(spark, sf_dir):
    items, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    own = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    a = items.select(own("supp", "l_suppkey").alias("name"), own("part", "l_partkey").alias("d"))
    b = supplier.select(own("nation", "s_nationkey").alias("name"), own("supp", "s_suppkey").alias("d"))
    return spread(a.unionByName(b), "name").groupBy("name").agg(F.collect_set("d").alias("depends_on"))


@R.add("n17_dependents", f"WITH {_NEEDS_SQL}, twice AS (SELECT DISTINCT a.name, b.required_by FROM needs a JOIN needs b ON b.name = a.required_by) SELECT name, required_by, 1::INTEGER AS depth FROM needs UNION ALL SELECT name, required_by, 2 FROM twice WHERE (name, required_by) NOT IN (SELECT (name, required_by) FROM needs)")
def n17_dependents(spark, sf_dir):
    return snapshots.dependents(_objects(spark, sf_dir), depth=2)


@R.add("a12_impact", f"WITH {_SNAP_SQL}, many AS (SELECT {_NAME.format(k='l_partkey')} AS name, count(DISTINCT l_suppkey) AS dependents FROM lineitem GROUP BY l_partkey) SELECT name, status, risk_level, coalesce(dependents, 0) AS dependents, list_filter([CASE WHEN starts_with(name, 'field.') THEN 'data_schema' END, CASE WHEN starts_with(name, 'views.view.') THEN 'ui_display' END, CASE WHEN starts_with(name, 'core.extension') THEN 'module_lifecycle' END], lambda x: x IS NOT NULL) AS touched_domains, list_filter([CASE WHEN risk_level = 'high' THEN 'backup' END, CASE WHEN coalesce(dependents, 0) > 0 THEN 'verify dependents' END], lambda x: x IS NOT NULL) AS followups FROM rated LEFT JOIN many USING (name) WHERE status <> 'identical'")
def a12_impact(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(_name(F.col("l_partkey")).alias("d"), F.col("l_suppkey").cast("string").alias("name"))
    needed = snapshots.dependents(spread(items, "name").groupBy("name").agg(F.collect_set("d").alias("depends_on")))
    return snapshots.impact(snapshots.diff(*_snapshots(spark, sf_dir)), needed)


@R.add("a12_deployment_risk", f"WITH {_SNAP_SQL} SELECT count(*) AS drifting, count(*) FILTER (contains(name, 'field.storage') OR contains(name, 'core.extension')) AS risky, min(CASE WHEN contains(name, 'field.storage') OR contains(name, 'core.extension') THEN name END) AS first_risky FROM rated WHERE status <> 'identical'")
def a12_deployment_risk(spark, sf_dir):
    return snapshots.deployment_risk(snapshots.drift(snapshots.diff(*_snapshots(spark, sf_dir))))


# --- incremental -------------------------------------------------------------

_FILES_SQL = """scanned AS (SELECT source || '/' || doc_id AS file_path, n_chars AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS hash FROM documents WHERE lang <> 'es'),
stored AS (SELECT source || '/' || doc_id AS file_path, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 6 = 0 THEN doc_id ELSE doc_id * 1000 END AS mtime_ns,
  CASE WHEN doc_id % 12 = 0 THEN 'x' ELSE sha256(text) END AS hash, CASE WHEN doc_id % 10 = 1 THEN 'pending_parse' WHEN doc_id % 10 = 3 THEN 'error' ELSE 'parsed' END AS status, doc_id % 5 AS retry_count FROM documents WHERE lang <> 'de')"""


def _files(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    path, digest = F.concat("source", F.lit("/"), i.cast("string")), F.sha2("text", 256)
    scanned = docs.filter("lang <> 'es'").select(path.alias("file_path"), F.col("n_chars").alias("size"), (i * 1000).alias("mtime_ns"), digest.alias("hash"))
    stored = docs.filter("lang <> 'de'").select(path.alias("file_path"), F.when(i % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), F.when(i % 6 == 0, i).otherwise(i * 1000).alias("mtime_ns"), F.when(i % 12 == 0, "x").otherwise(digest).alias("hash"), F.when(i % 10 == 1, "pending_parse").when(i % 10 == 3, "error").otherwise("parsed").alias("status"), (i % 5).alias("retry_count"))
    return scanned, stored


@R.add("i1_file_changes", f"WITH {_FILES_SQL} SELECT coalesce(s.file_path, o.file_path) AS file_path, CASE WHEN s.file_path IS NULL THEN 'deleted' WHEN o.file_path IS NULL THEN 'new' WHEN coalesce((s.size = o.size AND s.mtime_ns = o.mtime_ns) OR s.hash = o.hash, false) AND o.status IN ('parsed', 'up_to_date') THEN 'up_to_date' ELSE 'pending_parse' END AS state FROM scanned s FULL OUTER JOIN stored o ON s.file_path = o.file_path")
def i1_file_changes(spark, sf_dir):
    return inc.changes(*_files(spark, sf_dir))


@R.add("i2_outdated_chunks", f"""WITH {_FILES_SQL} SELECT doc_id AS chunk_id, CASE WHEN s.file_path IS NOT NULL AND o.file_path IS NOT NULL AND NOT (coalesce((s.size = o.size AND s.mtime_ns = o.mtime_ns) OR s.hash = o.hash, false) AND o.status IN ('parsed', 'up_to_date')) THEN 'stale' ELSE 'embedded' END AS status
FROM documents d LEFT JOIN scanned s ON s.file_path = d.source || '/' || doc_id LEFT JOIN stored o ON o.file_path = d.source || '/' || doc_id""")
def i2_outdated_chunks(spark, sf_dir):
    """Documents as embedded chunks of a file each; those of changed files are stale."""
    queue = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.lit("embedded").alias("status"))
    return inc.outdated(queue, inc.changes(*_files(spark, sf_dir))).select("chunk_id", "status")


@R.add("q9_retryable_files", f"WITH {_FILES_SQL} SELECT file_path, status, retry_count FROM stored WHERE status IN ('pending_parse', 'error') AND retry_count < 3")
def q9_retryable_files(spark, sf_dir):
    return inc.retryable(_files(spark, sf_dir)[1]).select("file_path", "status", "retry_count")


@R.add("k1_upsert", "SELECT d.doc_id AS chunk_id, CASE WHEN l.doc_id IS NOT NULL THEN 'new: ' || text ELSE text END AS text, CASE WHEN l.doc_id IS NOT NULL THEN 2 ELSE 1 END AS version FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def k1_upsert(spark, sf_dir):
    """All documents, then those with labels once more."""
    docs = table(spark, sf_dir, "documents")
    old = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.lit(1).alias("version"))
    new = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("new: "), "text").alias("text"), F.lit(2).alias("version"))
    return inc.upsert(old, new, ["chunk_id"], distinct=True)


_QUEUE2_SQL = "chunk_queue AS (SELECT o_orderkey AS chunk_id, o_orderpriority AS raw_text, CASE WHEN o_orderstatus = 'F' THEN 'embedded' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'error' END AS status, 1 + o_orderkey % 3 AS priority, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at, o_orderkey % 4 AS retry_count FROM orders)"


def _chunk_queue(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "embedded").when(F.col("o_orderstatus") == "O", "pending").otherwise("error")
    return table(spark, sf_dir, "orders").select(k.alias("chunk_id"), F.col("o_orderpriority").alias("raw_text"), status.alias("status"), (1 + k % 3).alias("priority"), F.unix_timestamp("o_orderdate").alias("created_at"), (k % 4).alias("retry_count"))


@R.add("k2_requeue", f"WITH {_QUEUE2_SQL}, incoming AS (SELECT l_orderkey * 2 AS chunk_id, min(l_shipdate)::VARCHAR || '' AS t, 'new ' || l_orderkey AS raw_text, 3::BIGINT AS priority FROM lineitem GROUP BY l_orderkey) SELECT coalesce(q.chunk_id, i.chunk_id) AS chunk_id, CASE WHEN i.chunk_id IS NOT NULL THEN i.raw_text ELSE q.raw_text END AS raw_text, CASE WHEN i.chunk_id IS NOT NULL THEN 'pending' ELSE q.status END AS status, CASE WHEN i.chunk_id IS NOT NULL THEN i.priority ELSE q.priority END AS priority, coalesce(created_at, {NOW}) AS created_at, coalesce(retry_count, 0) AS retry_count FROM chunk_queue q FULL OUTER JOIN incoming i ON q.chunk_id = i.chunk_id")
def k2_requeue(spark, sf_dir):
    incoming = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().select((F.col("l_orderkey") * 2).alias("chunk_id"), F.concat(F.lit("new "), F.col("l_orderkey").cast("string")).alias("raw_text"), F.lit(3).cast("long").alias("priority"))
    return inc.requeue(_chunk_queue(spark, sf_dir), incoming, NOW)


@R.add("o5_next_batch", f"WITH {_QUEUE2_SQL} SELECT chunk_id, priority, created_at FROM chunk_queue WHERE status = 'pending' ORDER BY priority DESC, created_at, chunk_id LIMIT 20")
def o5_next_batch(spark, sf_dir):
    return inc.next_batch(_chunk_queue(spark, sf_dir), 20).select("chunk_id", "priority", "created_at")


@R.add("k6_mark_error", f"WITH {_QUEUE2_SQL} SELECT chunk_id, CASE WHEN raw_text = '1-URGENT' THEN 'error' ELSE status END AS status, retry_count + CASE WHEN raw_text = '1-URGENT' THEN 1 ELSE 0 END AS retry_count FROM chunk_queue")
def k6_mark_error(spark, sf_dir):
    rows = _chunk_queue(spark, sf_dir)
    return inc.mark(rows, rows.filter("raw_text = '1-URGENT'"), "error").select("chunk_id", "status", "retry_count")


@R.add("a7_progress", f"WITH {_QUEUE2_SQL}, n AS (SELECT count(*) FILTER (status = 'embedded') AS done, count(*) FILTER (status IN ('embedded', 'pending')) AS total FROM chunk_queue) SELECT done, total, least(round(100 * done / total, 1), 100.0) AS percent, round(done / 40.0::DOUBLE, 4) AS rate, CAST(ceil((total - done) / round(done / 40.0::DOUBLE, 4)) AS BIGINT) AS eta FROM n")
def a7_progress(spark, sf_dir):
    return inc.progress(_chunk_queue(spark, sf_dir), 40.0)


@R.add("r14_priority", "SELECT doc_id, CAST(CASE WHEN 1000000000000000 - doc_id * 1000000000000 < 86400000000000 THEN 2 ELSE 1 END AS INTEGER) AS priority FROM documents")
def r14_priority(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", inc.priority(1, F.col("doc_id") * 1_000_000_000_000, 1_000_000_000_000_000).alias("priority"))


@R.add("k9_latest_run", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def k9_latest_run(spark, sf_dir):
    """The latest row of each run's log."""
    return inc.current(table(spark, sf_dir, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@R.add("k7_delete_by_path", f"WITH {_FILES_SQL} SELECT file_path, status FROM stored WHERE file_path NOT IN (SELECT file_path FROM scanned)")
def k7_delete_by_path(spark, sf_dir):
    """What is stored without the files that were scanned."""
    scanned, stored = _files(spark, sf_dir)
    return stored.join(scanned.select("file_path"), "file_path", "left_anti").select("file_path", "status")


@R.add("k8_set_enriched_text", f"WITH {_QUEUE2_SQL}, more AS (SELECT o_orderkey AS chunk_id, 'rich ' || o_orderkey AS text FROM orders WHERE o_orderstatus = 'P') SELECT chunk_id, coalesce(text, raw_text) AS text FROM chunk_queue LEFT JOIN more USING (chunk_id)")
def k8_set_enriched_text(spark, sf_dir):
    more = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("rich "), F.col("o_orderkey").cast("string")).alias("text"))
    return _chunk_queue(spark, sf_dir).join(more, "chunk_id", "left").select("chunk_id", F.coalesce("text", "raw_text").alias("text"))


@R.add("d13_queue_errors", f"WITH {_QUEUE2_SQL} SELECT status, retry_count, count(*) AS n, min(created_at) AS oldest FROM chunk_queue GROUP BY status, retry_count")
def d13_queue_errors(spark, sf_dir):
    return _chunk_queue(spark, sf_dir).groupBy("status", "retry_count").agg(F.count("*").alias("n"), F.min("created_at").alias("oldest"))


@R.add("a3_filtered_counts", f"WITH {_QUEUE2_SQL} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (priority = 3) AS urgent FROM chunk_queue")
def a3_filtered_counts(spark, sf_dir):
    return _chunk_queue(spark, sf_dir).agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("priority") == 3).alias("urgent"))


# --- runs and repairs --------------------------------------------------------

_RUNS_SQL = "runs AS (SELECT 'r' || event_id AS run_id, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'running' END AS status, CAST(floor(epoch(ts)) AS BIGINT) AS started_at, CAST(floor(epoch(ts)) AS BIGINT) + event_id % 900 AS updated_at FROM events)"
_RUNS_NOW = 1_704_900_000


def _runs(spark, sf_dir):
    i, ts = F.col("event_id"), F.unix_timestamp("ts")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("r"), i.cast("string")).alias("run_id"), F.when(i % 3 == 0, "completed").otherwise("running").alias("status"), ts.alias("started_at"), (ts + i % 900).alias("updated_at"))


@R.add("i7_lock_holders", f"WITH {_RUNS_SQL} SELECT run_id, updated_at FROM runs WHERE status = 'running' AND {_RUNS_NOW} - updated_at < 600")
def i7_lock_holders(spark, sf_dir):
    """Events as runs: those that still hold the index."""
    return runs.holders(_runs(spark, sf_dir), _RUNS_NOW).select("run_id", "updated_at")


@R.add("d13_stuck_runs", f"WITH {_RUNS_SQL} SELECT run_id, {_RUNS_NOW} - updated_at AS silent FROM runs WHERE status = 'running' AND {_RUNS_NOW} - updated_at >= 600")
def d13_stuck_runs(spark, sf_dir):
    return runs.stuck(_runs(spark, sf_dir), _RUNS_NOW).select("run_id", "silent")


@R.add("d13_fingerprints", f"WITH {_FILES_SQL} SELECT count(*) AS files, count(*) FILTER (s.file_path IS NOT NULL AND o.hash IS DISTINCT FROM s.hash) AS changed, count(*) FILTER (s.file_path IS NULL) AS gone FROM stored o LEFT JOIN scanned s ON s.file_path = o.file_path")
def d13_fingerprints(spark, sf_dir):
    scanned, stored = _files(spark, sf_dir)
    return runs.fingerprints(stored, scanned)


@R.add("d14_repended", f"WITH {_QUEUE2_SQL} SELECT chunk_id, CASE WHEN status = 'embedded' AND chunk_id % 10 <> 0 THEN 'pending' ELSE status END AS status FROM chunk_queue")
def d14_repended(spark, sf_dir):
    """Every embedded chunk without a vector is pending again; here those have one whose id ends in 0."""
    rows = _chunk_queue(spark, sf_dir)
    missing = rows.filter("status = 'embedded'").join(rows.filter("chunk_id % 10 = 0").select("chunk_id"), "chunk_id", "left_anti")
    return runs.repended(rows, missing).select("chunk_id", "status")


@R.add("d14_retried", f"WITH {_QUEUE2_SQL} SELECT chunk_id, CASE WHEN status = 'error' THEN 'pending' ELSE status END AS status, CASE WHEN status = 'error' THEN 0 ELSE retry_count END AS retry_count FROM chunk_queue")
def d14_retried(spark, sf_dir):
    return runs.retried(_chunk_queue(spark, sf_dir)).select("chunk_id", "status", "retry_count")


@R.add("d14_without_stale", f"WITH {_FILES_SQL} SELECT file_path, status FROM stored WHERE file_path IN (SELECT file_path FROM scanned)")
def d14_without_stale(spark, sf_dir):
    scanned, stored = _files(spark, sf_dir)
    stale = stored.select("file_path").join(scanned.select("file_path"), "file_path", "left_anti")
    return runs.without_files(stored, stale).select("file_path", "status")


@R.add("t_since", f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN {NOW} - event_id % 30 * 86400 WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 2 THEN event_id WHEN 3 THEN {NOW} - 3600 * (event_id % 7) END AS at FROM events")
def t_since(spark, sf_dir):
    """Relative, ISO and plain times of the log, and text that is none."""
    i = F.col("event_id")
    text = F.when(i % 5 == 0, F.concat(F.lit("-"), (i % 30).cast("string"), F.lit(" days"))).when(i % 5 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(i % 5 == 2, i.cast("string")).when(i % 5 == 3, F.concat((i % 7).cast("string"), F.lit(" hours ago"))).otherwise("some day")
    return table(spark, sf_dir, "events").select("event_id", dates.epoch(text, NOW).alias("at"))
