"""Catalog and health queries over parts, suppliers, customers, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import catalogs as c
from lodestone.operators import health
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import CHUNKS_SQL, VECTORS_SQL, chunks, vectors

R = Registry()


@R.add("q10_affixes", "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'bolt') OR starts_with(p_name, 'cold') OR contains(p_name, 'l w')")
def q10_affixes(spark, sf_dir):
    name = F.col("p_name")
    return table(spark, sf_dir, "part").filter(name.endswith("bolt") | name.startswith("cold") | name.contains("l w")).select("p_partkey", "p_name")


@R.add("q12_runtime_filter", "SELECT c_name, c_mktsegment FROM customer WHERE contains(c_name, '77') OR contains(lower(c_mktsegment), 'furn')")
def q12_runtime_filter(spark, sf_dir):
    return c.matching(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "77").unionByName(c.matching(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment", "furn")).select("c_name", "c_mktsegment").distinct()


@R.add("q13_exact", "SELECT s_name FROM supplier WHERE s_name = 'Supplier#000000001'")
def q13_exact(spark, sf_dir):
    return c.exact_or_matching(table(spark, sf_dir, "supplier"), "s_name", "Supplier#000000001").select("s_name")


@R.add("q13_substring", "SELECT s_name FROM supplier WHERE contains(s_name, '00000000')")
def q13_substring(spark, sf_dir):
    return c.exact_or_matching(table(spark, sf_dir, "supplier"), "s_name", "00000000").select("s_name")


@R.add("o10_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def o10_page(spark, sf_dir):
    return c.page(table(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"], 25, 50).select("o_orderkey", "o_totalprice")


@R.add("w7_first_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def w7_first_per_key(spark, sf_dir):
    return c.best_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def _routes(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    route = F.concat_ws(".", F.lit("r"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string"))
    return items.select(route.alias("route"), F.concat(F.lit("\\App\\Form\\Supplier"), (F.col("l_suppkey") * 2).cast("string"), F.lit("::build")).alias("controller"))


_ROUTES = r"routes AS (SELECT DISTINCT 'r.' || l_orderkey || '.' || l_linenumber || '.' || l_suppkey AS route, 'Supplier' || l_suppkey * 2 AS class, '\App\Form\Supplier' || l_suppkey * 2 || '::build' AS controller FROM lineitem)"


@R.add("n13_route_handlers", f"WITH {_ROUTES}, classes AS (SELECT 'Supplier' || s_suppkey AS class, min('src/' || s_nationkey || '.php') AS file FROM supplier GROUP BY s_suppkey) SELECT route, controller, file, CASE WHEN file IS NULL THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM routes LEFT JOIN classes USING (class)")
def n13_route_handlers(spark, sf_dir):
    classes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")).alias("class"), F.concat(F.lit("src/"), F.col("s_nationkey").cast("string"), F.lit(".php")).alias("file"))
    return c.handlers(_routes(spark, sf_dir), classes)


@R.add("n14_form_routes", f"WITH {_ROUTES}, found AS (SELECT class AS form, list_sort(list(DISTINCT route)) AS routes FROM routes GROUP BY class) SELECT 'Supplier' || s_suppkey AS form, coalesce(routes, []) AS routes FROM supplier LEFT JOIN found ON form = 'Supplier' || s_suppkey")
def n14_form_routes(spark, sf_dir):
    forms = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier"), F.col("s_suppkey").cast("string")).alias("form"))
    return c.forms_with_routes(forms, _routes(spark, sf_dir))


@R.add("o7_trace", "SELECT * FROM (SELECT 'part' AS domain, p_name || p_partkey AS name, round(p_retailprice / 2000, 4) AS confidence FROM part UNION ALL SELECT 'supplier', s_name, round(abs(s_acctbal) / 20000, 4) FROM supplier UNION ALL SELECT 'nation', n_name, 0.5::DOUBLE FROM nation) ORDER BY confidence DESC, domain, name LIMIT 5")
def o7_trace(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.lit("part").alias("domain"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.round(F.col("p_retailprice") / 2000, 4).alias("confidence"))
    supplier = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("domain"), F.col("s_name").alias("name"), F.round(F.abs("s_acctbal") / 20000, 4).alias("confidence"))
    nation = table(spark, sf_dir, "nation").select(F.lit("nation").alias("domain"), F.col("n_name").alias("name"))
    return c.trace(part, supplier, nation)


@R.add("e2_search_objects", "SELECT 'customer' AS kind, id FROM (SELECT c_name AS id FROM customer WHERE contains(c_name, '12') ORDER BY id LIMIT 5) UNION ALL SELECT 'supplier', id FROM (SELECT s_name AS id FROM supplier WHERE contains(s_name, '12') ORDER BY id LIMIT 5)")
def e2_search_objects(spark, sf_dir):
    return c.search("12", customer=table(spark, sf_dir, "customer").withColumnRenamed("c_name", "id"), supplier=table(spark, sf_dir, "supplier").withColumnRenamed("s_name", "id"))


@R.add("v9_map_entries", "SELECT n_nationkey AS file, unnest(['svc.' || n_nationkey, 'svc.b']) AS name, unnest([n_name, 'r' || n_regionkey]) AS value FROM nation")
def v9_map_entries(spark, sf_dir):
    key = F.concat(F.lit("svc."), F.col("n_nationkey").cast("string"))
    mapping = F.create_map(F.lit("_defaults"), F.lit("x"), key, F.col("n_name"), F.lit("svc.b"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")))
    return c.entries(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file"), mapping.alias("m")), "file", "m")


def _yaml(spark, sf_dir, text):
    """Nations as parsed YAML files: {0}, {1} and {2} stand for the key, the region and the name."""
    data = F.format_string(text.replace("{0}", "%1$d").replace("{1}", "%2$d").replace("{2}", "%3$s"), "n_nationkey", "n_regionkey", "n_name")
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("file_path"), data.alias("data"))


@R.add("v9_services", "SELECT unnest(['a.' || n_nationkey, 'bare']) AS service_id, unnest(['C' || n_regionkey, '']) AS class, unnest([[n_name, 'late'], []]) AS tags, 'f' || n_nationkey AS file FROM nation")
def v9_services(spark, sf_dir):
    return c.services(_yaml(spark, sf_dir, '{"services": {"_defaults": {"class": "D"}, "alias": "@other", "a.{0}": {"class": "C{1}", "tags": [{"name": "{2}"}, "plain", {"priority": 1}, {"name": "late", "priority": 2}]}, "bare": {}}}'))


@R.add("v9_routes", "SELECT unnest(['r.' || n_nationkey, 'form', 'none']) AS route_name, unnest(['/n/{id}/' || n_nationkey, '/form', '']) AS path, unnest(['C' || n_regionkey || '::page', 'F' || n_name, '']) AS controller, 'f' || n_nationkey AS file FROM nation")
def v9_routes(spark, sf_dir):
    return c.routes(_yaml(spark, sf_dir, '{"r.{0}": {"path": "/n/{id}/{0}", "defaults": {"_controller": "C{1}::page", "_form": "unused"}}, "form": {"path": "/form", "defaults": {"_form": "F{2}"}}, "none": {}, "text": "x"}'))


_KINDS = "['entity_reference', 'image', 'string', 'file', 'integer', 'entity_reference_revisions'][1 + p_partkey % 6]"


@R.add("v12_reference_edges", f"SELECT bundle, field, type, target_type, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS target_bundle FROM (SELECT p_brand AS bundle, 'f' || p_partkey AS field, {_KINDS} AS type, CASE WHEN p_size % 3 = 0 THEN 'node' ELSE p_type END AS target_type, CASE WHEN p_size % 4 = 0 THEN [] ELSE ['b' || p_size % 5, 'b' || p_size % 7 || 'x'] END AS t FROM part) WHERE type IN ('entity_reference', 'entity_reference_revisions', 'image', 'file')")
def v12_reference_edges(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ["entity_reference", "image", "string", "file", "integer", "entity_reference_revisions"]))
    targets = F.when(size % 4 != 0, F.array(F.concat(F.lit("b"), (size % 5).cast("string")), F.concat(F.lit("b"), (size % 7).cast("string"), F.lit("x"))))
    fields = table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), F.concat(F.lit("f"), k.cast("string")).alias("field"), F.element_at(kinds, (1 + k % 6).cast("int")).alias("type"), F.when(size % 3 != 0, F.col("p_type")).alias("target_type"), targets.alias("target_bundles"))
    return c.reference_edges(fields)


_USAGE = f"SELECT 'f' || p_partkey % 40 AS field, {_KINDS.replace('p_partkey', '(p_partkey % 40)')} AS type, list_sort(list(DISTINCT p_brand)) AS bundles, count(DISTINCT p_brand) AS n FROM part GROUP BY ALL"


def _fields(spark, sf_dir):
    k = F.col("p_partkey") % 40
    kinds = F.array(*map(F.lit, ["entity_reference", "image", "string", "file", "integer", "entity_reference_revisions"]))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("bundle"), F.concat(F.lit("f"), k.cast("string")).alias("field"), F.element_at(kinds, (1 + k % 6).cast("int")).alias("type"))


@R.add("v13_field_usage", _USAGE)
def v13_field_usage(spark, sf_dir):
    """Every field and the brands, as bundles, that use it."""
    return c.field_usage(_fields(spark, sf_dir))


@R.add("v13_field_usage_of_bundle", f"SELECT * FROM ({_USAGE}) WHERE list_contains(bundles, (SELECT min(p_brand) FROM part))")
def v13_field_usage_of_bundle(spark, sf_dir):
    return c.field_usage(_fields(spark, sf_dir), table(spark, sf_dir, "part").agg(F.min("p_brand")).first()[0])


@R.add("v11_enrichment", "SELECT part.p_partkey, p_name AS summary, CASE WHEN p_size % 2 = 0 THEN [lower(p_brand), lower(p_type)] ELSE [lower(p_type)] END AS tags FROM part")
def v11_enrichment(spark, sf_dir):
    tags = F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" , "), "p_type")).otherwise(F.concat("p_type", F.lit("\n,")))
    reply = F.concat(F.lit("SUMMARY:  "), "p_name", F.lit(" \nTAGS: "), tags)
    return table(spark, sf_dir, "part").select("p_partkey", c.enrichment(reply).alias("e")).select("p_partkey", "e.summary", "e.tags")


@R.add("config_owners", "WITH shipped AS (SELECT p_name || '.' || p_partkey AS name, min(p_brand) AS m FROM part WHERE p_type = 'PROMO' GROUP BY ALL), mods AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_type = 'PROMO') SELECT n.name, coalesce(m, CASE WHEN b IS NOT NULL THEN head END) AS owner, CASE WHEN m IS NOT NULL THEN 1.0::DOUBLE WHEN b IS NOT NULL THEN 0.9 ELSE 0.1 END AS confidence FROM (SELECT p_name || '.' || p_partkey AS name, p_name AS head FROM part UNION ALL SELECT p_brand || '.x' || p_partkey, p_brand FROM part) n LEFT JOIN shipped USING (name) LEFT JOIN mods ON b = head")
def config_owners(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey").cast("string")
    own = F.concat("p_name", F.lit("."), k)
    names = part.select(own.alias("name")).unionByName(part.select(F.concat("p_brand", F.lit(".x"), k).alias("name")))
    return c.owners(names, part.filter("p_type = 'PROMO'").select(own.alias("name"), F.col("p_brand").alias("module")))


@R.add("template_suggestions", "WITH n AS (SELECT DISTINCT 'node__' || replace(p_name, ' ', '_') || '__' || lower(p_type) AS name, replace(replace(p_name, ' ', '_'), '_', '-') AS a, lower(p_type) AS b FROM part) SELECT name, 3 AS place, 'node.html.twig' AS suggestion FROM n UNION ALL SELECT name, 2, 'node--' || a || '.html.twig' FROM n UNION ALL SELECT name, 1, 'node--' || a || '--' || b || '.html.twig' FROM n")
def template_suggestions(spark, sf_dir):
    name = F.concat(F.lit("node__"), F.translate("p_name", " ", "_"), F.lit("__"), F.lower("p_type"))
    return c.file_suggestions(table(spark, sf_dir, "part").select(name.alias("name")).distinct())


@R.add("a11_inventory", "SELECT count(*) AS items, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, list_sort(list(DISTINCT p_type)) AS type_names FROM part")
def a11_inventory(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.array_sort(F.collect_set("p_type")).alias("type_names"))


@R.add("n19_bundle_workflow", "SELECT n_name, (SELECT min(s_name) FROM supplier WHERE s_nationkey = n_nationkey) AS workflow FROM nation")
def n19_bundle_workflow(spark, sf_dir):
    first = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("workflow"))
    return table(spark, sf_dir, "nation").join(first, "n_nationkey", "left").select("n_name", "workflow")


# --- health ------------------------------------------------------------------

_HEALTH = f"{CHUNKS_SQL}, {VECTORS_SQL}, chunk_queue AS (SELECT chunk_id, file_path, schema_version, CASE WHEN CAST(chunk_id AS BIGINT) % 4 = 1 THEN 'pending' ELSE 'embedded' END AS status, mtime_ns AS indexed_at FROM chunks)"


def _queue(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", "file_path", "schema_version", F.when(F.col("chunk_id").cast("long") % 4 == 1, "pending").otherwise("embedded").alias("status"), F.col("mtime_ns").alias("indexed_at"))


@R.add("a1_index_status", f"WITH {_HEALTH} SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'embedded') AS embedded, count(DISTINCT file_path) AS files, max(indexed_at) AS last_indexed FROM chunk_queue")
def a1_index_status(spark, sf_dir):
    rows = _queue(spark, sf_dir)
    return health.status(rows, rows.groupBy("file_path").agg(F.max("indexed_at").alias("indexed_at")))


@R.add("n10_missing_vectors", f"WITH {_HEALTH} SELECT chunk_id FROM chunk_queue WHERE status = 'embedded' AND chunk_id NOT IN (SELECT chunk_id FROM vectors)")
def n10_missing_vectors(spark, sf_dir):
    return health.missing_vectors(_queue(spark, sf_dir), vectors(spark, sf_dir))


@R.add("n11_extra_vectors", f"WITH {_HEALTH} SELECT chunk_id FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_queue WHERE status = 'embedded')")
def n11_extra_vectors(spark, sf_dir):
    return health.extra_vectors(_queue(spark, sf_dir), vectors(spark, sf_dir))


@R.add("d7_counts_agree", f"WITH {_HEALTH}, n AS (SELECT (SELECT count(*) FROM chunk_queue WHERE status = 'embedded') AS queued, (SELECT count(*) FROM vectors) AS stored) SELECT queued, stored, CASE WHEN abs(queued - stored) <= greatest(10, floor(0.05::DOUBLE * greatest(queued, stored))) THEN 'ok' WHEN greatest(queued, stored) > 10 * greatest(least(queued, stored), 1) THEN 'error' ELSE 'warning' END AS level FROM n")
def d7_counts_agree(spark, sf_dir):
    return health.counts_agree(_queue(spark, sf_dir), vectors(spark, sf_dir))


@R.add("d9_versions", f"WITH {_HEALTH} SELECT count(*) AS declared, count(*) FILTER (schema_version = '1.0') AS compatible, count(*) FILTER (schema_version IS NULL OR schema_version IN ('', 'unknown')) AS unversioned, round((count(*) - count(*) FILTER (schema_version = '1.0')) / count(*), 6) AS stale_ratio, round((count(*) - count(*) FILTER (schema_version = '1.0')) / count(*), 6) > 0.1 AS warn FROM chunks")
def d9_versions(spark, sf_dir):
    return health.versions(chunks(spark, sf_dir), "1.0")


@R.add("d10_stale_files", f"WITH {_HEALTH} SELECT DISTINCT file_path FROM chunk_queue WHERE file_path NOT IN (SELECT file_path FROM chunks WHERE language = 'en')")
def d10_stale_files(spark, sf_dir):
    return health.stale_files(_queue(spark, sf_dir), chunks(spark, sf_dir).filter("language = 'en'"))


@R.add("a4_distinct_versions", f"WITH {CHUNKS_SQL} SELECT schema_version, count(*) AS n, count(DISTINCT project_path) AS projects FROM chunks GROUP BY schema_version")
def a4_distinct_versions(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("schema_version").agg(F.count("*").alias("n"), F.count_distinct("project_path").alias("projects"))


@R.add("n12_id_semi_join", f"WITH {CHUNKS_SQL}, {VECTORS_SQL} SELECT chunk_id, file_path FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM vectors)")
def n12_id_semi_join(spark, sf_dir):
    return chunks(spark, sf_dir).join(vectors(spark, sf_dir), "chunk_id", "left_semi").select("chunk_id", "file_path")


@R.add("d14_backfill", f"WITH {_HEALTH}, old AS (SELECT chunk_id, status, CASE WHEN schema_version = '0.9' THEN 'unknown' ELSE schema_version END AS schema_version FROM chunk_queue) SELECT chunk_id, CASE WHEN schema_version = 'unknown' AND status = 'embedded' THEN 'pending' ELSE status END AS status, CASE WHEN schema_version = 'unknown' THEN '1.0' ELSE schema_version END AS schema_version FROM old")
def d14_backfill(spark, sf_dir):
    rows = _queue(spark, sf_dir).withColumn("schema_version", F.when(F.col("schema_version") == "0.9", "unknown").otherwise(F.col("schema_version")))
    return health.backfilled(rows, "1.0").select("chunk_id", "status", "schema_version")



@R.add("q11_custom_modules", "SELECT p_partkey, p_name FROM part WHERE contains('/modules/' || CASE WHEN p_partkey % 3 = 0 THEN 'custom/' ELSE 'contrib/' END, '/custom/') AND (contains(lower(p_name), 'wid') OR contains(lower(p_brand), 'brand#1'))")
def q11_custom_modules(spark, sf_dir):
    path = F.concat(F.lit("/modules/"), F.when(F.col("p_partkey") % 3 == 0, "custom/").otherwise("contrib/"))
    rows = table(spark, sf_dir, "part").filter(path.contains("/custom/"))
    return rows.filter(F.lower("p_name").contains("wid") | F.lower("p_brand").contains("brand#1")).select("p_partkey", "p_name")


@R.add("q17_blocks_of_region", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def q17_blocks_of_region(spark, sf_dir):
    return table(spark, sf_dir, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name")


@R.add("a13_editorial_summary", "SELECT p_type, count(*) AS items, count(DISTINCT p_brand) AS brands, list_sort(list(DISTINCT p_name))[1:10] AS first_names FROM part GROUP BY p_type")
def a13_editorial_summary(spark, sf_dir):
    """Counts per kind and its ten least names, as the report shows."""
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("items"), F.count_distinct("p_brand").alias("brands"), F.slice(F.array_sort(F.collect_set("p_name")), 1, 10).alias("first_names"))


@R.add("e3_difference", "SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE'")
def e3_difference(spark, sf_dir):
    few = table(spark, sf_dir, "customer").filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_custkey").distinct().join(few, "o_custkey", "left_anti")


@R.add("e4_key_intersection", "SELECT doc_id, list_filter(['doc_id', 'lang', 'source'], lambda x: x IN ('lang', 'text', 'source')) AS keys FROM documents")
def e4_key_intersection(spark, sf_dir):
    keys = F.array_intersect(F.array(*map(F.lit, ["doc_id", "lang", "source"])), F.array(*map(F.lit, ["lang", "text", "source"])))
    return table(spark, sf_dir, "documents").select("doc_id", keys.alias("keys"))


@R.add("e5_attributes_and_relations", "SELECT p_partkey AS id, 'attribute' AS kind, p_name AS name FROM part UNION ALL SELECT p_partkey, 'relation', p_brand FROM part")
def e5_attributes_and_relations(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = lambda kind, c: part.select(F.col("p_partkey").alias("id"), F.lit(kind).alias("kind"), F.col(c).alias("name"))
    return one("attribute", "p_name").unionByName(one("relation", "p_brand"))


@R.add("a9_excerpts_per_file", "SELECT n_regionkey AS file, count(s_suppkey) AS excerpts FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_regionkey")
def a9_excerpts_per_file(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("n_regionkey").alias("file")).agg(F.count("s_suppkey").alias("excerpts"))


@R.add("j3_projection", f"WITH {CHUNKS_SQL} SELECT chunk_id, language, tags FROM chunks")
def j3_projection(spark, sf_dir):
    """The allowed columns that there are, without the denied ones."""
    rows, allow, deny = chunks(spark, sf_dir), ["chunk_id", "language", "tags", "text", "unknown"], {"text"}
    return rows.select([c for c in allow if c in rows.columns and c not in deny])


@R.add("d11_index_freshness", f"WITH {VECTORS_SQL} SELECT count(*) AS vectors, count(*) < 5000 AS fresh FROM vectors")
def d11_index_freshness(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("vectors"), (F.count("*") < health.REBUILD).alias("fresh"))
