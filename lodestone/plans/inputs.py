"""How the test tables stand in for an index of text chunks, its queue and its graph.

Each view comes twice: as a DataFrame and as a common table expression in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.base import table

#: "Now" of every query that ages rows, in nanoseconds.
NOW_NS = 1_700_000_000_000_000_000
SCHEMA_VERSION = "1.0"

CHUNKS_SQL = f"""
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source AS project_path, '/' || source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' WHEN doc_id % 3 = 1 THEN '.py' ELSE '.txt' END AS file_path,
         lang AS language, text, n_chars, [lang, source] AS tags, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {NOW_NS} - doc_id * 3600000000000 END AS mtime_ns,
         'fn_' || doc_id % 50 AS function_name, 'Class' || doc_id % 20 AS class_name, CASE WHEN doc_id % 97 = 0 THEN '0.9' ELSE '{SCHEMA_VERSION}' END AS schema_version
  FROM documents
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: one per document."""
    docs = table(spark, sf_dir, "documents")
    i, name = F.col("doc_id"), F.col("doc_id").cast("string")
    ext = F.when(i % 3 == 0, ".md").when(i % 3 == 1, ".py").otherwise(".txt")
    return docs.select(
        name.alias("chunk_id"),
        F.col("source").alias("project_path"),
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name, ext).alias("file_path"),
        F.col("lang").alias("language"),
        "text",
        "n_chars",
        F.array("lang", "source").alias("tags"),
        F.when(i % 5 != 0, F.lit(NOW_NS) - i * F.lit(3_600_000_000_000)).alias("mtime_ns"),
        F.concat(F.lit("fn_"), (i % 50).cast("string")).alias("function_name"),
        F.concat(F.lit("Class"), (i % 20).cast("string")).alias("class_name"),
        F.when(i % 97 == 0, "0.9").otherwise(SCHEMA_VERSION).alias("schema_version"),
    )


VECTORS_SQL = "vectors AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, embedding AS vector FROM embeddings)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings, under the ids of chunks."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vector"))


#: One query vector for all vector queries: a fixed wave of 64 numbers.
QUERY_VECTOR = [round(((i * 37) % 64 - 31.5) / 32, 4) for i in range(64)]


LINES_SQL = "lines AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, CAST(turn AS BIGINT) AS start_line, conv_id || ':' || turn AS chunk_id, role, text FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as files of chunks in reading order."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.col("turn").cast("long").alias("start_line"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"), "role", "text")


GRAPH_SQL = """
nodes AS (
  SELECT 'd' || doc_id AS node_id, 'fn_' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END AS symbol_name, 'pkg' || doc_id // 20 || '.fn_' || doc_id AS symbol_path,
         'function' AS symbol_type, 'pkg/' || doc_id // 20 || '.py' AS file_path, doc_id % 20 * 10 + 1 AS start_line FROM documents
), hops AS (
  SELECT DISTINCT doc_id AS a, unnest([doc_id // 2, doc_id * 2 + n_chars % 2, doc_id + 1 + n_chars % 5]) AS b FROM documents
), edges AS (
  SELECT 'd' || a AS source_node_id, 'fn_' || b AS target_node_name, 'd' || doc_id AS target_node_id, 'calls' AS relationship_type FROM hops LEFT JOIN documents ON doc_id = b
  UNION ALL SELECT 'd' || doc_id, 'lib_' || lang, NULL, 'imports' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT 'd' || doc_id, 'External' || n_chars % 4, NULL, 'calls' FROM documents WHERE n_chars % 3 = 0
)"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as the functions of a code graph: each calls a few others, some that aren't there, and a third of them call one of four external names."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    i, text = F.col("doc_id"), lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    package = F.expr("doc_id div 20")
    nodes = docs.select(text("d", i).alias("node_id"), text("fn_", F.when(i % 10 == 9, i - 1).otherwise(i)).alias("symbol_name"), F.concat(text("pkg", package), text(".fn_", i)).alias("symbol_path"), F.lit("function").alias("symbol_type"), F.concat(text("pkg/", package), F.lit(".py")).alias("file_path"), (i % 20 * 10 + 1).alias("start_line"))
    hops = docs.select(i.alias("a"), F.explode(F.array_distinct(F.array(F.expr("doc_id div 2"), i * 2 + F.col("n_chars") % 2, i + 1 + F.col("n_chars") % 5))).alias("b"))
    calls = hops.join(docs.select(i.alias("c")), F.col("b") == F.col("c"), "left").select(text("d", F.col("a")).alias("source_node_id"), text("fn_", F.col("b")).alias("target_node_name"), text("d", F.col("c")).alias("target_node_id"), F.lit("calls").alias("relationship_type"))
    nowhere = lambda name, kind: (text("d", i).alias("source_node_id"), name.alias("target_node_name"), F.lit(None).cast("string").alias("target_node_id"), F.lit(kind).alias("relationship_type"))
    imports = docs.filter(i % 4 == 0).select(*nowhere(F.concat(F.lit("lib_"), "lang"), "imports"))
    unknown = docs.filter(F.col("n_chars") % 3 == 0).select(*nowhere(text("External", F.col("n_chars") % 4), "calls"))
    return nodes, calls.unionByName(imports).unionByName(unknown)
