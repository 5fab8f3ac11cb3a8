"""Indexing as one flow: changed files are chunked, their symbols and words stored, chunks queued, embedded in batches and kept with their vectors.

State lies in keyed tables (files, queue, vectors, nodes, edges, runs, stats) and in
the word index, each of which takes batches of changes.  A file counts as parsed only
when all that follows from it is written, and writing it again changes nothing, so a
run that is interrupted goes on from what is there.  One run at a time holds the lease;
each commit checks it.  A pause is a mark of its own that only ``resume`` takes away.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import chunking, codegraph, graph, health, incremental
from lodestone.operators.folder import Folder, Lease, Locked, Lost
from lodestone.operators.keyed import Keyed
from lodestone.operators.scratch import written
from lodestone.operators.wordindex import WordIndex

__all__ = ["Indexer", "Locked", "Lost"]

SCHEMA_VERSION = "1.0"
FILES = "file_path string, size long, mtime_ns long, hash string, status string, retry_count long, message string, indexed_at long"
QUEUE = (
    "chunk_id string, project_path string, file_path string, language string, start_line int, end_line int, raw_text string, n_chars long, content_hash string, node_type string, class_name string, "
    "function_name string, symbol_path string, tags array<string>, mtime_ns long, schema_version string, status string, priority int, created_at long, retry_count int"
)
VECTORS = "chunk_id string, vector array<float>"
NODES = "node_id string, symbol_name string, symbol_path string, symbol_type string, file_path string, start_line long, end_line long, chunk_id string"
EDGES = "source_node_id string, target_node_name string, relationship_type string, target_node_id string, ambiguous boolean"
RUNS = "run_id string, status string, started_at long, updated_at long, message string"
STATS = "run_id string, pending long, embedded long, errors long, files long, updated_at long"
# Failed batches in a row that end a run; languages of files that aren't code.
FAILURES = 3
_PROSE = {"md": "markdown", "markdown": "markdown", "rst": "rst", "txt": "text", "html": "html", "htm": "html", "xml": "xml", "svg": "xml"}


def language(path) -> F.Column:
    """A file's language by its extension."""
    named = chunking.EXTENSIONS | _PROSE
    return F.create_map(*(F.lit(x) for pair in named.items() for x in pair))[t.extension(path)]


class Indexer:
    """One index in a folder: ``start`` takes changed files in, ``resume`` embeds what is pending, ``pause`` stops after the batch at hand.

    ``embed`` gives (chunk_id, vector) of a batch of the queue; ``chunker`` the chunks of files, as ``chunking.chunk_files``.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[DataFrame], DataFrame], batch: int = 10_000, clock: Callable[[], float] = time.time, project: str = "", chunker: Callable[[DataFrame], DataFrame] = chunking.chunk_files):
        self.spark, self.root, self.embed, self.batch, self.clock, self.project, self.chunker = spark, root.rstrip("/"), embed, batch, clock, project, chunker
        self.folder = Folder(spark, root)
        self.lease = Lease(self.folder, clock)
        table = lambda name, schema, key, buckets=16: Keyed(spark, f"{self.root}/{name}", schema, key, buckets, self.lease.check)
        self.files, self.queue, self.vectors = table("files", FILES, ["file_path"]), table("queue", QUEUE, ["chunk_id"]), table("vectors", VECTORS, ["chunk_id"])
        self.nodes, self.edges = table("nodes", NODES, ["node_id"]), table("edges", EDGES, ["source_node_id", "target_node_name", "relationship_type"])
        self.runs, self.stats = table("runs", RUNS, ["run_id"], 1), table("stats", STATS, ["run_id"], 1)
        self.words = WordIndex(spark, f"{self.root}/words", self.lease.check)

    @property
    def tables(self) -> dict[str, Keyed]:
        return {"files": self.files, "queue": self.queue, "vectors": self.vectors, "nodes": self.nodes, "edges": self.edges, "runs": self.runs, "stats": self.stats}

    # --- runs ---

    def _log(self, run: str, status: str, started: int, message: str | None = None) -> None:
        """What is known of a run; also says that it is alive."""
        self.lease.beat()
        self.runs.change(self.spark.createDataFrame([(run, status, started, int(self.clock()), message)], RUNS))

    def paused(self, run: str) -> bool:
        return self.folder.exists(f"_pause/{run}")

    def pause(self, run: str) -> None:
        """Asks a run, in whatever process, to stop after the batch at hand."""
        self.folder.put(f"_pause/{run}", "")

    def start(self, files: DataFrame, priority: int = 1, force: bool = False) -> str:
        """Takes in new and changed files (file_path, size, mtime_ns, hash, text), forgets deleted ones, then embeds; the run's id."""
        return self._run(files, None, priority, force)

    def take(self, files: DataFrame, gone: DataFrame, priority: int = 1, force: bool = False) -> str:
        """As ``start``, but of some files only: takes in these, forgets those that are gone (file_path) and leaves all others as they are."""
        return self._run(files, gone, priority, force)

    def _run(self, files: DataFrame, gone: DataFrame | None, priority: int, force: bool) -> str:
        run, now = uuid.uuid4().hex, int(self.clock())
        self.lease.take(run)
        try:
            self._log(run, "running", now)
            self._take_in(files, gone, priority, now, force)
            self._drain(run, now)
        finally:
            self._let_go()
        return run

    def resume(self, run: str) -> str:
        """Goes on with a paused or interrupted run."""
        now = int(self.clock())
        self.lease.take(run)
        try:
            self.folder.delete(f"_pause/{run}")
            self._log(run, "running", now)
            self._drain(run, now)
        finally:
            self._let_go()
        return run

    def _let_go(self) -> None:
        try:
            self.lease.check()
        except Lost:
            return
        self.lease.release()

    # --- files to chunks, symbols and words ---

    def _take_in(self, files: DataFrame, gone: DataFrame | None, priority: int, now: int, force: bool) -> None:
        """``gone``: the files that are no longer there; None if they are all that aren't among ``files``."""
        stored = self.files.read()
        if gone is not None:
            stored = stored.join(files.select("file_path").unionByName(gone.select("file_path")).distinct(), "file_path", "left_semi")
        states = written(incremental.changes(files, stored, force), "states")
        given_up = stored.filter((F.col("status") == "parse_error") & (F.col("retry_count") >= incremental.MAX_RETRIES)).select("file_path", "hash") if not force else stored.select("file_path", "hash").limit(0)
        changed = files.join(states.filter(F.col("state").isin("new", "pending_parse")).select("file_path"), "file_path", "left_semi").join(given_up, ["file_path", "hash"], "left_anti")
        gone = states.filter("state = 'deleted'").select("file_path")
        made = written(self.chunker(changed), "chunks")
        errors = made.filter("error is not null").groupBy("file_path").agg(F.min("error").alias("message"))
        fresh = written(self._chunks(made.filter("error is null"), changed, priority, now), "fresh")
        touched = written(changed.select("file_path").unionByName(gone).distinct(), "touched")
        old = written(self.queue.read().join(touched, "file_path", "left_semi").select("chunk_id", "status"), "old")
        lost = old.select("chunk_id").join(fresh.select("chunk_id"), "chunk_id", "left_anti")
        self.words.change(fresh.select("chunk_id", F.col("raw_text").alias("text")), lost)
        self._symbols(changed, touched, fresh)
        self.vectors.change(gone=lost)
        # chunks that are the same and embedded stay so
        same = old.filter("status = 'embedded'").select("chunk_id")
        self.queue.change(fresh.join(same, "chunk_id", "left_anti"), lost)
        tries = stored.select("file_path", "hash", F.col("retry_count").alias("_tries"))
        parsed = changed.select("file_path", "size", "mtime_ns", "hash").join(errors, "file_path", "left").join(tries, ["file_path", "hash"], "left")
        failed = F.col("message").isNotNull()
        self.files.change(parsed.select("file_path", "size", "mtime_ns", "hash", F.when(failed, "parse_error").otherwise("parsed").alias("status"), F.when(failed, F.coalesce("_tries", F.lit(0)) + 1).otherwise(0).cast("long").alias("retry_count"), "message", F.lit(now).cast("long").alias("indexed_at")), gone)

    def _chunks(self, made: DataFrame, changed: DataFrame, priority: int, now: int) -> DataFrame:
        """Rows of the queue."""
        tags = F.col("tags") if "tags" in changed.columns else F.array().cast("array<string>")
        rows = made.join(changed.select("file_path", "mtime_ns", tags.alias("tags")), "file_path").withColumn("project_path", F.lit(self.project))
        key = t.chunk_id(F.col("project_path"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("raw_text"))
        level = incremental.priority(priority, F.col("mtime_ns"), int(self.clock() * 1_000_000_000))
        own = {"chunk_id": key, "language": language(F.col("file_path")), "n_chars": F.length("raw_text").cast("long"), "content_hash": F.sha2("raw_text", 256), "schema_version": F.lit(SCHEMA_VERSION), "status": F.lit("pending"), "priority": level.cast("int"), "created_at": F.lit(now).cast("long"), "retry_count": F.lit(0)}
        return rows.withColumns(own).select(*self.queue.columns).dropDuplicates(["chunk_id"])

    def _symbols(self, changed: DataFrame, touched: DataFrame, fresh: DataFrame) -> None:
        """Nodes and edges of the changed files in place of those of the touched ones; calls are resolved where names came or went."""
        before = written(self.nodes.read().join(touched, "file_path", "left_semi").select("node_id"), "before")
        rows = changed.filter(chunking.route(F.col("file_path")) == "ast").select("file_path", "text").withColumn("project_path", F.lit(self.project))
        if before.isEmpty() and rows.isEmpty():
            return
        parts = codegraph.code_graph(rows), codegraph.line_graph(rows)
        nodes, edges = (written(a.unionByName(b), "symbols") for a, b in zip(*parts, strict=True))
        spans = fresh.select("file_path", F.col("chunk_id").alias("symbol"), F.col("start_line").cast("long").alias("start"), F.col("end_line").cast("long").alias("end"))
        held = graph.enclosing(spans, nodes.select("file_path", F.col("start_line").alias("line")).distinct(), slack=0).select("file_path", F.col("line").alias("start_line"), F.col("symbol").alias("chunk_id"))
        gone = written(before.join(nodes.select("node_id"), "node_id", "left_anti"), "gone")
        edge_key = self.edges.key
        kept = self.edges.read()
        mine = kept.join(before.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi")
        dead = mine.select(*edge_key).join(edges.select(*edge_key), edge_key, "left_anti")
        loose = kept.join(gone.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi").join(before.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_anti")
        new = written(edges.select(*edge_key).unionByName(loose.select(*edge_key)).distinct(), "edges")
        dead = written(dead, "dead")
        self.nodes.change(nodes.join(held, ["file_path", "start_line"], "left"), gone)
        self.edges.change(new.withColumn("target_node_id", F.lit(None).cast("string")).withColumn("ambiguous", F.lit(False)), dead)
        # unresolved calls of new edges, and those to names that came with these files
        open_ = self.edges.read().filter("target_node_id is null")
        named = nodes.select(F.col("symbol_name").alias("target_node_name")).distinct()
        again = open_.join(new, edge_key, "left_semi").unionByName(open_.join(named, "target_node_name", "left_semi").join(new, edge_key, "left_anti"))
        solved = written(graph.resolve(again.select(*edge_key, "target_node_id"), self.nodes.read()).filter("target_node_id is not null"), "solved")
        self.edges.change(solved)

    # --- chunks to vectors ---

    def _drain(self, run: str, started: int) -> None:
        """Batches by priority until none is pending, the run is paused, or ``FAILURES`` batches in a row have failed."""
        failures, message = 0, None
        while True:
            if self.paused(run):
                self._log(run, "paused", started, message)
                break
            batch = written(incremental.next_batch(self.queue.read(), self.batch), "batch")
            if batch.isEmpty():
                self._log(run, "completed", started, message)
                break
            try:
                made = written(self.embed(batch).select("chunk_id", F.col("vector").cast("array<float>").alias("vector")).filter("vector is not null").dropDuplicates(["chunk_id"]), "made")
                failures = 0
            except Exception as problem:  # whatever an embedder raises is its batch's state, and said in the log
                made, failures = self.vectors.read().limit(0), failures + 1
                message = str(problem).split("\n")[0] or type(problem).__name__
            self.vectors.change(made.join(batch.select("chunk_id"), "chunk_id", "left_semi"))
            done = made.select("chunk_id", F.lit(True).alias("_done"))
            marked = batch.join(done, "chunk_id", "left").withColumn("status", F.when(F.col("_done"), "embedded").otherwise("error")).withColumn("retry_count", F.col("retry_count") + F.when(F.col("_done"), 0).otherwise(1))
            self.queue.change(marked.drop("_done"))
            if failures >= FAILURES:
                self._log(run, "error", started, message)
                break
            self._log(run, "running", started, message)
        self._keep_stats(run)

    def _keep_stats(self, run: str) -> None:
        """What the index holds at the end of a run, or where it was paused."""
        of = lambda status: F.count_if(F.col("status") == status)
        row = self.queue.read().agg(F.lit(run).alias("run_id"), of("pending").alias("pending"), of("embedded").alias("embedded"), of("error").alias("errors"), F.count_distinct("file_path").alias("files"), F.lit(int(self.clock())).cast("long").alias("updated_at"))
        self.stats.change(written(row, "stats"))

    # --- what there is ---

    def chunks(self) -> DataFrame:
        """The chunks as searches take them."""
        return self.queue.read().filter("status <> 'stale'").withColumnRenamed("raw_text", "text")

    def engine(self, embed: Callable[[str], list[float]] | None = None):
        """Searches over the index as it is now."""
        from lodestone.engine import Engine

        state = ":".join(str(x.version()) for x in self.tables.values())
        return Engine(self.chunks(), self.vectors.read(), self.queue.read(), self.nodes.read(), self.edges.read(), self.words if self.words.commits.last()[0] else None, embed, version=state)

    def health(self) -> list[tuple[str, bool, str]]:
        """(name, healthy, message): whether each table has a commit whose rows can be read, the word index, and whether the folder can be written."""
        out = []
        for name, table in self.tables.items():
            try:
                n = table.version()
                table.read().limit(1).collect()
                out.append((name, n > 0, f"version {n}" if n else "not built"))
            except Exception as problem:  # whatever a broken table raises is its state
                out.append((name, False, str(problem).split("\n")[0]))
        n = self.words.commits.last()[0]
        out.append(("words", n > 0, f"version {n}" if n else "not built"))
        try:
            self.folder.put("_probe", "")
            self.folder.delete("_probe")
            out.append(("folder", True, "writable"))
        except Exception as problem:
            out.append(("folder", False, str(problem).split("\n")[0]))
        return out

    def unparsed(self) -> DataFrame:
        """(file_path) of the files that couldn't be parsed and are tried again."""
        return self.files.read().filter((F.col("status") == "parse_error") & (F.col("retry_count") < incremental.MAX_RETRIES)).select("file_path")

    def status(self) -> DataFrame:
        """One row: pending and embedded chunks, files, and when one was last indexed."""
        return health.status(self.queue.read(), self.files.read())

    def doctor(self, fix: bool = False) -> DataFrame:
        """(check, count, healthy): vectors that are missing or over, versions, failed chunks and files; ``fix`` makes what is missing or failed pending and removes what is over."""
        queue, vectors = self.queue.read(), self.vectors.read()
        missing, extra, failed = health.missing_vectors(queue, vectors), health.extra_vectors(queue, vectors), queue.filter("status = 'error'")
        other = queue.filter(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION))
        checks = {"missing_vectors": missing, "extra_vectors": extra, "other_versions": other, "queue_errors": failed, "parse_errors": self.files.read().filter("status = 'parse_error'")}
        found = None
        for name, rows in checks.items():
            one = rows.agg(F.lit(name).alias("check"), F.count("*").alias("count")).withColumn("healthy", F.col("count") == 0)
            found = one if found is None else found.unionByName(one)
        found = written(found, "doctor")
        if fix:
            self.lease.take("doctor")
            try:
                again = queue.join(missing.select("chunk_id").unionByName(failed.select("chunk_id")).distinct(), "chunk_id", "left_semi")
                pending = written(again.withColumns({"status": F.lit("pending"), "retry_count": F.lit(0)}), "pending")
                over = written(extra.select("chunk_id"), "over")
                self.queue.change(pending)
                self.vectors.change(gone=over)
            finally:
                self._let_go()
        return found

    def progress(self, elapsed: float) -> DataFrame:
        return incremental.progress(self.queue.read(), elapsed)

    def vacuum(self) -> None:
        """Removes what no last commit reads."""
        for table in self.tables.values():
            table.vacuum()
        self.words.vacuum()

    def delete(self) -> bool:
        """Removes the index with all its tables."""
        return self.folder.delete()
