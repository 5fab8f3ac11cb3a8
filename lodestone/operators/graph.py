"""Callers, callees, imports and shortest call paths over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scratch import written

MAX_DEPTH = 3
#: Levels of a path search after which the nodes seen are written as one table.
SEEN_LEVELS = 8


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a target get the node of that name, of several the one with the least id, and ``ambiguous``."""
    named = nodes.groupBy("symbol_name").agg(F.min("node_id").alias("_id"), (F.count("*") > 1).alias("_many"))
    joined = edges.join(named, F.col("target_node_name") == F.col("symbol_name"), "left")
    unknown = F.col("target_node_id").isNull()
    return joined.select("source_node_id", "target_node_name", F.coalesce("target_node_id", "_id").alias("target_node_id"), "relationship_type", (unknown & F.coalesce("_many", F.lit(False))).alias("ambiguous"))


def callers(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(depth, source_path, file_path, target_node_name, relationship_type) of all edges into a name, then into the names that called it.

    A name is expanded at its least depth only.
    """
    joined = edges.join(nodes.select(F.col("node_id").alias("source_node_id"), "symbol_name", F.col("symbol_path").alias("source_path"), "file_path"), "source_node_id")
    level = edges.sparkSession.createDataFrame([(name,)], "target_node_name string")
    seen, out = level, None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        found = joined.join(level, "target_node_name", "left_semi").withColumn("depth", F.lit(d))
        out = found if out is None else out.unionByName(found)
        level = found.select(F.col("symbol_name").alias("target_node_name")).distinct().join(seen, "target_node_name", "left_anti")
        seen = seen.unionByName(level)
    return out.select("depth", "source_path", "file_path", "target_node_name", "relationship_type")


def callees(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """(depth, source, target, target_type, target_file, relationship_type) of all edges out of a node and of what it reaches.

    The root is the node with that path or name, of several the one with the least
    id; unresolved targets are given but not followed.
    """
    root = nodes.filter((F.col("symbol_path") == name) | (F.col("symbol_name") == name)).orderBy("node_id").limit(1).select("node_id")
    source = nodes.select(F.col("node_id").alias("source_node_id"), F.col("symbol_path").alias("source"))
    target = nodes.select(F.col("node_id").alias("target_node_id"), F.col("symbol_path").alias("_path"), "symbol_type", F.col("file_path").alias("_file"))
    level = root.select(F.col("node_id").alias("source_node_id"))
    seen, out = level, None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        found = edges.join(level, "source_node_id", "left_semi").withColumn("depth", F.lit(d))
        out = found if out is None else out.unionByName(found)
        level = found.filter("target_node_id is not null").select(F.col("target_node_id").alias("source_node_id")).distinct().join(seen, "source_node_id", "left_anti")
        seen = seen.unionByName(level)
    rows = out.join(source, "source_node_id").join(target, "target_node_id", "left")
    known = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return rows.select("depth", "source", known("_path", F.col("target_node_name")).alias("target"), known("symbol_type", F.lit("unresolved")).alias("target_type"), known("_file", F.lit("external")).alias("target_file"), "relationship_type")


def imports(nodes: DataFrame, edges: DataFrame, file_path: str | None = None) -> DataFrame:
    """(source_file, imported) of all import edges, or of one file's."""
    rows = edges.filter("relationship_type = 'imports'").join(nodes.select(F.col("node_id").alias("source_node_id"), "file_path"), "source_node_id")
    if file_path is not None:
        rows = rows.filter(F.col("file_path") == file_path)
    return rows.select(F.col("file_path").alias("source_file"), F.col("target_node_name").alias("imported"))


def trace_path(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(path) from one symbol to another over call edges: the shortest, of equal ones the least; no row if there is none.

    Breadth first with parent paths, until nothing new is reached: each level
    joins the frontier with the calls and keeps the least path to each node not
    seen before, so a level is no larger than the graph.  Levels are written, so
    plans don't grow with them.  A call to a name without a node ends there: it can
    be the target, but isn't followed.
    """
    is_ = lambda x: (F.col("symbol_path") == x) | (F.col("symbol_name") == x)
    known = nodes.select(F.col("node_id").alias("target_node_id"), F.col("node_id").alias("_id"), "symbol_path", "symbol_name")
    calls = edges.filter("relationship_type = 'calls'").join(known, "target_node_id", "left")
    name = F.coalesce(F.nullif("symbol_path", F.lit("")), "target_node_name")
    calls = written(calls.select("source_node_id", F.col("_id").alias("node_id"), name.alias("_name"), F.coalesce((name == target) | is_(target), F.lit(False)).alias("_hit")), "calls")
    first = nodes.filter(is_(source)).select("node_id", F.array("symbol_path").alias("path"), F.when(is_(target), F.array("symbol_path")).alias("found"))
    level = written(first, "level")
    seen, depth = level.select("node_id"), 0
    while True:
        found, some = level.agg(F.min("found"), F.count("node_id")).first()
        if found is not None or not some:
            return level.agg(F.min("found").alias("path")).filter("path is not null")
        step = calls.join(level.select(F.col("node_id").alias("source_node_id"), "path"), "source_node_id").filter("node_id is not null or _hit").join(seen, "node_id", "left_anti")
        path = F.concat("path", F.array("_name"))
        level = written(step.groupBy("node_id").agg(F.min(path).alias("path"), F.min(F.when(F.col("_hit"), path)).alias("found")), "level")
        seen, depth = seen.unionByName(level.select("node_id")), depth + 1
        if depth % SEEN_LEVELS == 0:
            seen = written(seen, "seen")


def enclosing(spans: DataFrame, sites: DataFrame, slack: int = 10) -> DataFrame:
    """Sites (file_path, line) with the ``symbol`` whose span (file_path, symbol, start, end) holds them, ending up to ``slack`` lines later.

    Of nested symbols the one that starts last; null where there is none.  The
    range is joined by blocks of lines within a file, so a long file is no
    product of its sites and spans.
    """
    block = 64
    low, high = F.floor(F.col("start") / block), F.floor((F.col("end") + slack) / block)
    cut = spans.withColumn("_b", F.explode(F.sequence(low, high)))
    joined = sites.withColumn("_b", F.floor(F.col("line") / block)).join(cut, ["file_path", "_b"]).filter((F.col("line") >= F.col("start")) & (F.col("line") <= F.col("end") + slack))
    best = joined.groupBy("file_path", "line").agg(F.max_by("symbol", F.struct("start", "symbol")).alias("symbol"))
    return sites.join(best, ["file_path", "line"], "left")


def delete_file(nodes: DataFrame, edges: DataFrame, file_path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a file: its nodes and their edges go, edges into it lose their target."""
    gone = nodes.filter(F.col("file_path") == file_path).select("node_id")
    left = nodes.join(gone, "node_id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_anti")
    marked = kept.join(gone.select(F.col("node_id").alias("target_node_id"), F.lit(True).alias("_gone")), "target_node_id", "left")
    return left, marked.withColumn("target_node_id", F.when(F.col("_gone").isNull(), F.col("target_node_id"))).select(*edges.columns)


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the given order, on equal ones the greatest in all columns; combined before the shuffle."""
    named = [*order, *(c for c in rows.columns if c not in order)]
    best = rows.groupBy(*key).agg(F.max(F.struct(*named)).alias("_best"))
    return best.select(*(F.col(f"_best.{c}").alias(c) for c in rows.columns))
