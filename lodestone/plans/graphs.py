"""Graph queries: callers, callees, imports, paths, resolution, deletion, enclosing symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import codegraph
from lodestone.operators import graph as g
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import GRAPH_SQL, graph

R = Registry()


@R.add("g1_callers", f"""WITH RECURSIVE {GRAPH_SQL}, joined AS (SELECT edges.*, symbol_name, symbol_path AS source_path, file_path FROM edges JOIN nodes ON node_id = source_node_id),
reach(name, depth) AS (SELECT 'fn_20', 0 UNION SELECT symbol_name, depth + 1 FROM reach JOIN joined ON target_node_name = name WHERE depth < 2),
least AS (SELECT name, min(depth) AS depth FROM reach GROUP BY name)
SELECT CAST(depth + 1 AS INTEGER) AS depth, source_path, file_path, target_node_name, relationship_type FROM least JOIN joined ON target_node_name = name""")
def g1_callers(spark, sf_dir):
    return g.callers(*graph(spark, sf_dir), "fn_20", depth=3)


@R.add("g2_callees", f"""WITH RECURSIVE {GRAPH_SQL}, reach(id, depth) AS (
  SELECT node_id, 0 FROM (SELECT node_id FROM nodes WHERE symbol_path = 'pkg1.fn_25' OR symbol_name = 'pkg1.fn_25' ORDER BY node_id LIMIT 1)
  UNION SELECT target_node_id, depth + 1 FROM reach JOIN edges ON source_node_id = id WHERE depth < 2 AND target_node_id IS NOT NULL
), least AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)
SELECT CAST(depth + 1 AS INTEGER) AS depth, s.symbol_path AS source, coalesce(t.symbol_path, target_node_name) AS target, coalesce(t.symbol_type, 'unresolved') AS target_type, coalesce(t.file_path, 'external') AS target_file, relationship_type
FROM least JOIN edges ON source_node_id = id JOIN nodes s ON s.node_id = id LEFT JOIN nodes t ON t.node_id = target_node_id""")
def g2_callees(spark, sf_dir):
    return g.callees(*graph(spark, sf_dir), "pkg1.fn_25", depth=3)


@R.add("g3_imports", f"WITH {GRAPH_SQL} SELECT file_path AS source_file, target_node_name AS imported FROM edges JOIN nodes ON node_id = source_node_id WHERE relationship_type = 'imports'")
def g3_imports(spark, sf_dir):
    return g.imports(*graph(spark, sf_dir))


@R.add("g4_trace_path", f"""WITH RECURSIVE {GRAPH_SQL}, walk(id, path, n) AS (
  SELECT node_id, [symbol_path], 0 FROM nodes WHERE symbol_name = 'fn_1'
  UNION ALL SELECT id, min(path), n + 1 FROM (SELECT node_id AS id, list_append(path, symbol_path) AS path, n FROM walk JOIN edges ON source_node_id = id AND relationship_type = 'calls' JOIN nodes ON node_id = target_node_id WHERE n < 12) GROUP BY id, n
) SELECT path FROM walk JOIN nodes ON node_id = id WHERE symbol_name = 'fn_150' ORDER BY n, path LIMIT 1""")
def g4_trace_path(spark, sf_dir):
    return g.trace_path(*graph(spark, sf_dir), "fn_1", "fn_150")


@R.add("n6_resolve_edges", f"WITH {GRAPH_SQL}, named AS (SELECT symbol_name, min(node_id) AS id, count(*) > 1 AS many FROM nodes GROUP BY symbol_name) SELECT source_node_id, target_node_name, id AS target_node_id, relationship_type, coalesce(many, false) AS ambiguous FROM edges LEFT JOIN named ON symbol_name = target_node_name")
def n6_resolve_edges(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return g.resolve(edges.withColumn("target_node_id", F.lit(None).cast("string")), nodes)


@R.add("k5_delete_file", f"WITH {GRAPH_SQL}, gone AS (SELECT node_id FROM nodes WHERE file_path = 'pkg/2.py') SELECT source_node_id, target_node_name, CASE WHEN target_node_id IN (SELECT node_id FROM gone) THEN NULL ELSE target_node_id END AS target_node_id, relationship_type FROM edges WHERE source_node_id NOT IN (SELECT node_id FROM gone)")
def k5_delete_file(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return g.delete_file(nodes, edges, "pkg/2.py")[1]


_SPANS = "spans AS (SELECT o_orderkey % 50 || '' AS file_path, 'o' || o_orderkey AS symbol, o_custkey AS start, o_custkey + o_orderkey % 40 AS stop FROM orders), sites AS (SELECT DISTINCT l_orderkey % 50 || '' AS file_path, l_suppkey * 7 AS line FROM lineitem)"


@R.add("n7_enclosing_symbol", f"WITH {_SPANS}, best AS (SELECT sites.file_path, line, max_by(symbol, (start, symbol)) AS symbol FROM sites JOIN spans ON sites.file_path = spans.file_path AND line BETWEEN start AND stop + 10 GROUP BY ALL) SELECT file_path, line, symbol FROM sites LEFT JOIN best USING (file_path, line)")
def n7_enclosing_symbol(spark, sf_dir):
    """orders as spans of lines in files, line items as call sites."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    spans = orders.select((F.col("o_orderkey") % 50).cast("string").alias("file_path"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("symbol"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 40).alias("end"))
    sites = items.select((F.col("l_orderkey") % 50).cast("string").alias("file_path"), (F.col("l_suppkey") * 7).alias("line")).distinct()
    return g.enclosing(spans, sites)


@R.add("k4_edge_upsert", f"WITH {GRAPH_SQL}, more AS (SELECT source_node_id, target_node_name, NULL AS target_node_id, relationship_type, 2 AS v FROM edges WHERE relationship_type = 'calls' UNION ALL SELECT *, 1 FROM edges) SELECT source_node_id, target_node_name, relationship_type, target_node_id FROM more QUALIFY row_number() OVER (PARTITION BY source_node_id, target_node_name, relationship_type ORDER BY v DESC) = 1")
def k4_edge_upsert(spark, sf_dir):
    """Edges seen again replace the old ones and lose their target until it is resolved anew."""
    edges = graph(spark, sf_dir)[1]
    again = edges.filter("relationship_type = 'calls'").withColumn("target_node_id", F.lit(None).cast("string")).withColumn("v", F.lit(2))
    both = edges.withColumn("v", F.lit(1)).unionByName(again)
    return g.latest(both, ["source_node_id", "target_node_name", "relationship_type"], ["v"]).drop("v")


@R.add("n8_symbol_to_chunk", "WITH spans AS (SELECT CAST(conv_id AS VARCHAR) AS file_path, conv_id || ':' || turn AS symbol, CAST(turn AS BIGINT) * 10 AS start, CAST(turn AS BIGINT) * 10 + 9 AS stop FROM conversations), sites AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS file_path, CAST(turn AS BIGINT) * 7 AS line FROM conversations), best AS (SELECT sites.file_path, line, max_by(symbol, (start, symbol)) AS symbol FROM sites JOIN spans ON sites.file_path = spans.file_path AND line BETWEEN start AND stop GROUP BY ALL) SELECT file_path, line, symbol FROM sites LEFT JOIN best USING (file_path, line)")
def n8_symbol_to_chunk(spark, sf_dir):
    """The chunk of ten lines that a line lies in."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("symbol"), (F.col("turn").cast("long") * 10).alias("start"))
    sites = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), (F.col("turn").cast("long") * 7).alias("line")).distinct()
    return g.enclosing(rows.withColumn("end", F.col("start") + 9), sites, slack=0)


# Suppliers as TypeScript files: a class with a method for each part, then a function.
_TS_SQL = """items AS (SELECT l_suppkey AS s, l_partkey AS p, min(l_linenumber) AS l FROM lineitem GROUP BY ALL),
methods AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY CAST(p AS VARCHAR)) AS i FROM items), sizes AS (SELECT s, count(*) AS n FROM items GROUP BY s)"""
_TS_ID = "sha256('demo|/src/s' || s || '.ts|' || {0})"


def _typescript(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_linenumber").alias("l"))
    method = F.concat(F.lit("  part_"), F.col("l_partkey").cast("string"), F.lit("(x) {\n    return this.call_"), F.col("l").cast("string"), F.lit("(x);\n  }"))
    body, k = items.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(method)).alias("m")), F.col("l_suppkey").cast("string")
    text = F.concat(F.lit("import { base } from './lib';\nclass Supplier"), k, F.lit(" extends Base {\n"), F.array_join("m", "\n"), F.lit("\n}\n\nfunction main() {\n  run();\n}\n"))
    return body.select(F.lit("demo").alias("project_path"), F.concat(F.lit("/src/s"), k, F.lit(".ts")).alias("file_path"), text.alias("text"))


@R.add("v5_graph_nodes", f"""WITH {_TS_SQL}, found AS (
  SELECT s, 'file' AS symbol_path, 's' || s || '.ts' AS symbol_name, 'file' AS symbol_type, 1 AS start_line, 8 + 3 * n AS end_line FROM sizes
  UNION ALL SELECT s, 'Supplier' || s, 'Supplier' || s, 'class', 2, 3 + 3 * n FROM sizes
  UNION ALL SELECT s, 'main', 'main', 'function', 5 + 3 * n, 7 + 3 * n FROM sizes
  UNION ALL SELECT s, 'Supplier' || s || '.part_' || p, 'part_' || p, 'method', 3 * i, 3 * i + 2 FROM methods
) SELECT {_TS_ID.format("symbol_path")} AS node_id, symbol_name, symbol_path, symbol_type, '/src/s' || s || '.ts' AS file_path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM found""")
def v5_graph_nodes(spark, sf_dir):
    return codegraph.code_graph(_typescript(spark, sf_dir))[0]


@R.add("v5_graph_edges", f"""WITH {_TS_SQL}, found AS (
  SELECT s, 'file' AS symbol_path, './lib' AS target, 'imports' AS kind FROM sizes UNION ALL SELECT s, 'main', 'run', 'calls' FROM sizes
  UNION ALL SELECT s, 'Supplier' || s || '.part_' || p, 'call_' || l, 'calls' FROM methods
) SELECT {_TS_ID.format("symbol_path")} AS source_node_id, target AS target_node_name, NULL::VARCHAR AS target_node_id, kind AS relationship_type FROM found""")
def v5_graph_edges(spark, sf_dir):
    return codegraph.code_graph(_typescript(spark, sf_dir))[1]
