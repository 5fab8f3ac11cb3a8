"""Lookups, projections, query terms, files of configuration, and searches of which a part is missing."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.engine import Engine
from lodestone.functions import text as t
from lodestone.operators import context, incremental
from lodestone.operators import retrieval as r
from lodestone.plans import retrieval as plans
from lodestone.operators.scratch import spread
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import CHUNKS_SQL, LINES_SQL, NOW_NS, chunks, turns, vectors
from lodestone.sources import config

R = Registry()


@R.add("s11_queue_lookup", f"WITH {LINES_SQL} SELECT chunk_id, file_path, role, text FROM lines WHERE chunk_id = '3:1'")
def s11_queue_lookup(spark, sf_dir):
    """One chunk of the queue, where there is no index yet."""
    return Engine(queue=turns(spark, sf_dir)).get("3:1", ["chunk_id", "file_path", "role", "text"])


@R.add("s13_queue_file_chunks", f"WITH {LINES_SQL} SELECT chunk_id, start_line, text FROM lines WHERE file_path = '5'")
def s13_queue_file_chunks(spark, sf_dir):
    return Engine(queue=turns(spark, sf_dir)).file_chunks("5").select("chunk_id", "start_line", "text")


@R.add("s14_column_query", f"WITH {CHUNKS_SQL} SELECT chunk_id, language FROM chunks WHERE schema_version = '0.9' AND n_chars > 100 ORDER BY chunk_id LIMIT 40")
def s14_column_query(spark, sf_dir):
    """Any columns of any rows, as many as asked for."""
    rows = chunks(spark, sf_dir).filter("schema_version = '0.9' AND n_chars > 100").orderBy("chunk_id").limit(40)
    return context.view(rows, ["chunk_id", "language", "no_such_column"])


@R.add("j4_projection", f"WITH {CHUNKS_SQL} SELECT chunk_id, CASE WHEN length(text) <= 60 THEN text ELSE substr(text, 1, 29) || chr(10) || '…' || chr(10) || right(text, 28) END AS text FROM chunks WHERE language = 'de'")
def j4_projection(spark, sf_dir):
    return context.view(chunks(spark, sf_dir).filter("language = 'de'"), ["chunk_id", "text"], max_chars=60)


@R.add("k3_fingerprints", "SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.hash, o.hash) AS hash FROM (SELECT 'f' || p_partkey AS file_path, md5(p_name) AS hash FROM part) o FULL OUTER JOIN (SELECT 'f' || ps * 3 AS file_path, md5('new') AS hash FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem)) n ON o.file_path = n.file_path")
def k3_fingerprints(spark, sf_dir):
    """Files' hashes, and those of a later scan over them; it names some files twice."""
    old = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_path"), F.md5(F.col("p_name").cast("binary")).alias("hash"))
    new = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), (F.col("l_suppkey") * 3).cast("string")).alias("file_path"), F.md5(F.lit("new").cast("binary")).alias("hash"))
    return incremental.upsert(old, new, ["file_path"])


_ORDERED = "list_transform(list_sort(list_transform(list_distinct(w), lambda x: {'i': list_position(w, x), 'x': x})), lambda s: s.x)"


@R.add("r9_query_terms", f"SELECT conv_id, turn, {_ORDERED} AS terms FROM (SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '[^a-z0-9_.]+'), lambda x: length(x) > 1) AS w FROM conversations)")
def r9_query_terms(spark, sf_dir):
    """The terms of each turn of the conversations, as if it were a query."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.terms_of(F.col("text")).alias("terms"))


_ASKED = "SELECT p_partkey, 'the getPart' || p_size || ' of ' || p_name || ' PartTable_' || p_partkey || ' a.b' || p_size || '.c ABC-' || p_size || ' v1.' || p_size || ' \"is it\" is' AS q FROM part"


def _asked(spark, sf_dir):
    k, n = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = [F.lit("the getPart"), n, F.lit(" of "), F.col("p_name"), F.lit(" PartTable_"), k, F.lit(" a.b"), n, F.lit(".c ABC-"), n, F.lit(" v1."), n, F.lit(' "is it" is')]
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")).select("p_partkey", F.concat(*parts).alias("q"))


_FOUND = " || ".join(f"regexp_extract_all(q, '{p}')" for p in t.IDENTIFIERS)


@R.add("r10_identifiers", f"SELECT p_partkey, {_ORDERED} AS identifiers FROM (SELECT p_partkey, list_filter({_FOUND} || list_transform(regexp_extract_all(q, '\"([^\"]+)\"', 1), lambda x: trim(x)), lambda x: length(x) > 1) AS w FROM ({_ASKED}))")
def r10_identifiers(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", t.identifiers_of(F.col("q")).alias("identifiers"))


_STOP = ", ".join(f"'{x}'" for x in sorted(t.STOP_WORDS))


@R.add("r9_keywords", f"SELECT p_partkey, list_filter({_ORDERED}, lambda x: NOT list_contains([{_STOP}], x)) AS keywords FROM (SELECT p_partkey, list_filter(string_split_regex(lower(q), '[^a-z0-9_.]+'), lambda x: length(x) > 1) AS w FROM ({_ASKED}))")
def r9_keywords(spark, sf_dir):
    """Terms without stop words; no identifier of these queries is one."""
    return _asked(spark, sf_dir).select("p_partkey", t.keywords_of(F.col("q")).alias("keywords"))


@R.add("s18_yaml_files", "SELECT n_name || '.yml' AS file_path, n_regionkey AS region, ['x' || n_nationkey, 'y'] AS list FROM nation WHERE n_nationkey % 5 <> 0")
def s18_yaml_files(spark, sf_dir):
    """Nations as YAML files, every fifth of them broken."""
    k = F.col("n_nationkey").cast("string")
    text = F.when(F.col("n_nationkey") % 5 != 0, F.concat(F.lit("region: "), F.col("n_regionkey").cast("string"), F.lit("\nlist:\n  - x"), k, F.lit("\n  - y\n"))).otherwise("a: [")
    files = table(spark, sf_dir, "nation").select(F.concat("n_name", F.lit(".yml")).alias("file_path"), text.alias("text"))
    found = config.yaml.parsed(files).withColumn("_v", F.parse_json("data"))
    return found.select("file_path", F.variant_get("_v", "$.region", "long").alias("region"), F.variant_get("_v", "$.list", "array<string>").alias("list"))


@R.add("s19_config_names", "SELECT 'part.' || p_partkey AS name, p_size AS size FROM part WHERE p_partkey % 3 <> 1 AND starts_with('part.' || p_partkey, 'part.1') ORDER BY name LIMIT 30")
def s19_config_names(spark, sf_dir):
    """Parts as the files of a configuration folder, some of another ending or in a folder below: the first names with a prefix."""
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 6 == 4, F.lit("below/")).otherwise(""), F.lit("part."), k.cast("string"), F.when(k % 6 == 1, F.lit(".json")).otherwise(".yml"))
    files = table(spark, sf_dir, "part").select(path.alias("file_path"), F.col("p_size").alias("size"))
    return config.named(files, "part.1", 30).select("name", "size")


_WORDS_ALONE = "b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS keyword_rank FROM top_words), fused AS (SELECT chunk_id, CAST(NULL AS BIGINT) AS vector_rank, keyword_rank, 1 / (60.0::DOUBLE + keyword_rank) AS fused FROM b)"


@R.add("d3_without_embedder", plans._hybrid_sql(r.GAP, _WORDS_ALONE))
def d3_without_embedder(spark, sf_dir):
    """A hybrid search whose query can't be embedded: keywords alone count, in full."""

    def down(query):
        raise OSError("no server")

    return Engine(chunks(spark, sf_dir), vectors(spark, sf_dir), embed=down, now_ns=lambda: NOW_NS).search(plans.QUERY).found


@R.add("d2_without_index", f"""{plans._LOW}, best AS (SELECT chunk_id, CAST({plans._LIKE} AS DOUBLE) AS score FROM low WHERE ({plans._LIKE_MATCH}) AND chunk_id IN (SELECT chunk_id FROM chunks WHERE schema_version = '1.0') ORDER BY score DESC, chunk_id LIMIT 50),
stepped AS (SELECT *, row_number() OVER w AS rank, lag(score) OVER w - score AS step, first_value(score) OVER w AS top FROM best WINDOW w AS (ORDER BY score DESC, chunk_id)),
cut AS (SELECT *, sum(CASE WHEN top > 0 AND step > 0.25::DOUBLE * top THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS cuts FROM stepped) SELECT rank, chunk_id, score FROM cut WHERE cuts = 0""")
def d2_without_index(spark, sf_dir):
    """Before there is an index the queue is searched by terms."""
    return Engine(queue=chunks(spark, sf_dir)).search("fn_7 class2 17 tion").found.select("rank", "chunk_id", "score")
