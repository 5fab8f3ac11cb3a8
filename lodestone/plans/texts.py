"""Queries on whole texts: truncation, markup, ids, lines, grep, chunks and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import html as h
from lodestone.functions import text as t
from lodestone.operators import chunking as ch
from lodestone.operators.scratch import spread
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import CHUNKS_SQL, chunks
from lodestone.sources import files

R = Registry()

_CUTS = {"head": "substr(text, 1, 100) || ' …'", "tail": "'… ' || right(text, 100)", "middle": "substr(text, 1, 49) || chr(10) || '…' || chr(10) || right(text, 48)"}


def _truncate(name: str, keep: str) -> None:
    @R.add(name, f"SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE {_CUTS[keep]} END AS text FROM documents")
    def query(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", t.truncate(F.col("text"), 100, keep).alias("text"))


for _k in _CUTS:
    _truncate(f"t1_truncate_{_k}", _k)


@R.add("t_strip_markup", f"SELECT page_id, {t.strip_markup_sql('html')} AS text FROM pages")
def t_strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", t.strip_markup(F.col("html")).alias("text"))


@R.add("t_chunk_ids", f"WITH {CHUNKS_SQL} SELECT chunk_id AS id, sha256(project_path || '|' || file_path || '|1|' || n_chars || '|' || substr(sha256(text), 1, 16)) AS chunk_id, sha256(text) AS content_hash FROM chunks")
def t_chunk_ids(spark, sf_dir):
    rows = chunks(spark, sf_dir)
    return rows.select(F.col("chunk_id").alias("id"), t.chunk_id(F.col("project_path"), F.col("file_path"), F.lit(1), F.col("n_chars"), F.col("text")).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


@R.add("t_paths", f"WITH {CHUNKS_SQL} SELECT chunk_id, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS ext FROM chunks")
def t_paths(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", t.stem(F.col("file_path")).alias("stem"), t.extension(F.col("file_path")).alias("ext"))


@R.add("j2_full_record", f"WITH {CHUNKS_SQL} SELECT chunk_id, coalesce(text, '') AS text, round(n_chars / 7.0::DOUBLE, 6) AS score FROM chunks WHERE schema_version = '1.0'")
def j2_full_record(spark, sf_dir):
    return chunks(spark, sf_dir).filter("schema_version = '1.0'").select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.round(F.col("n_chars") / 7.0, 6).alias("score"))


@R.add("j7_char_window", "SELECT doc_id, substr(text, 51, 100) AS text, CAST(length(text) AS BIGINT) AS total, length(text) > 150 AS more FROM documents")
def j7_char_window(spark, sf_dir):
    """Characters 51 to 150 of each text, with how long it is and whether more follow."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 51, 100).alias("text"), F.length("text").cast("long").alias("total"), (F.length("text") > 150).alias("more"))


@R.add("j10_json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def j10_json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@R.add("v4_route", "SELECT page_id, CASE WHEN e IN ('py', 'mts', 'cxx') THEN 'ast' WHEN e IN ('md', 'txt', 'markdown') THEN 'semantic' WHEN e IN ('html') THEN 'markup' WHEN e IN ('pdf') THEN 'document' ELSE 'skip' END AS route FROM (SELECT page_id, ['py', 'mts', 'cxx', 'md', 'markdown', 'json', 'html', 'pdf', 'png'][1 + page_id % 9] AS e FROM pages)")
def v4_route(spark, sf_dir):
    kinds = F.array(*map(F.lit, ["py", "mts", "cxx", "md", "markdown", "json", "html", "pdf", "png"]))
    path = F.concat(F.lit("/a.b/file."), F.element_at(kinds, (1 + F.col("page_id") % 9).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", ch.route(path).alias("route"))


_LINES = "lines AS (SELECT doc_id, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))"


@R.add("s15_grep", f"WITH {_LINES} SELECT doc_id, line, CAST(strpos(content, regexp_extract(content, 'th[a-z]+ble')) AS BIGINT) AS \"column\", regexp_extract(content, 'th[a-z]+ble') AS match FROM lines WHERE regexp_matches(content, 'th[a-z]+ble')")
def s15_grep(spark, sf_dir):
    return ch.grep(table(spark, sf_dir, "documents"), "doc_id", "th[a-z]+ble")


@R.add("w10_grep_context", f"WITH {_LINES}, framed AS (SELECT *, coalesce(list(content) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS before, coalesce(list(content) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS after FROM lines) SELECT doc_id, line, CAST(strpos(content, regexp_extract(content, '(AKIA|[Ll]icensed)[A-Z0-9]*')) AS BIGINT) AS \"column\", regexp_extract(content, '(AKIA|[Ll]icensed)[A-Z0-9]*') AS match, before, after FROM framed WHERE regexp_matches(content, '(AKIA|[Ll]icensed)[A-Z0-9]*')")
def w10_grep_context(spark, sf_dir):
    return ch.grep(table(spark, sf_dir, "documents"), "doc_id", "(AKIA|[Ll]icensed)[A-Z0-9]*", context=2)


@R.add("v6_calls", f"WITH {_LINES} SELECT DISTINCT doc_id, line, unnest(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS target FROM lines WHERE NOT regexp_matches(content, '^\\s*(?:def|func|fn|function|class|import|from|use|require)\\b')")
def v6_calls(spark, sf_dir):
    """Names before an opening bracket; flow words aren't among those of the test texts."""
    return ch.calls(table(spark, sf_dir, "documents"), "doc_id")


def _code(spark, sf_dir):
    """Suppliers and their parts as source files: a class per supplier, a method per line item."""
    items = table(spark, sf_dir, "lineitem")
    method = F.concat(F.lit("    def part_"), F.col("l_partkey").cast("string"), F.lit("(self):\n        return call_"), F.col("l_linenumber").cast("string"), F.lit("(x)"))
    body = items.groupBy("l_suppkey").agg(F.array_sort(F.collect_set(method)).alias("m"))
    text = F.concat(F.lit("import lib.base\nclass Supplier"), F.col("l_suppkey").cast("string"), F.lit(":\n"), F.array_join("m", "\n"), F.lit("\n\ndef main():\n    run()\n"))
    return body.select(F.col("l_suppkey").alias("file"), text.alias("text"), F.concat(F.lit("/src/s"), F.col("l_suppkey").cast("string"), F.lit(".py")).alias("file_path"))


_CODE = """code AS (SELECT l_suppkey AS file, 'import lib.base' || chr(10) || 'class Supplier' || l_suppkey || ':' || chr(10) || string_agg(DISTINCT m, chr(10) ORDER BY m) || chr(10) || chr(10) || 'def main():' || chr(10) || '    run()' || chr(10) AS text
  FROM (SELECT l_suppkey, '    def part_' || l_partkey || '(self):' || chr(10) || '        return call_' || l_linenumber || '(x)' AS m FROM lineitem) GROUP BY l_suppkey),
code_lines AS (SELECT file, generate_subscripts(l, 1) AS line, unnest(l) AS content FROM (SELECT file, string_split(text, chr(10)) AS l FROM code))"""


@R.add("w9_symbols", f"WITH {_CODE}, marked AS (SELECT *, CASE WHEN regexp_matches(content, '^\\s*class\\s+\\w') THEN 'class' WHEN regexp_matches(content, '^\\s*(def|func|fn|function)\\s+\\w') THEN 'function' END AS kind, regexp_extract(content, '^\\s*(?:class|def|func|fn|function)\\s+(\\w+)', 1) AS name, regexp_matches(content, '^(function|def|func|fn)') AS top FROM code_lines), run AS (SELECT *, last_value(CASE WHEN kind = 'class' THEN name WHEN top THEN '' END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line) AS s FROM marked) SELECT file, line, kind, name, CASE WHEN kind = 'function' THEN nullif(s, '') END AS scope FROM run WHERE kind IS NOT NULL")
def w9_symbols(spark, sf_dir):
    return ch.symbols(_code(spark, sf_dir), "file")


@R.add("v6_imports", f"WITH {_CODE} SELECT file, line, regexp_extract(content, '^\\s*import\\s+([\\w.]+)', 1) AS target FROM code_lines WHERE regexp_matches(content, '^\\s*import\\s+[\\w.]+')")
def v6_imports(spark, sf_dir):
    return ch.imports(_code(spark, sf_dir), "file")


@R.add("v1_code_chunks")
def v1_code_chunks(spark, sf_dir):
    """Order matters within a file, so no SQL: tests compare it with a plain loop."""
    return ch.chunk_code(_code(spark, sf_dir), "file")


@R.add("v3_prose_chunks")
def v3_prose_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return ch.chunk_prose(docs.withColumn("file_path", F.lit("a.md")), "doc_id")


@R.add("html_outline")
def html_outline(spark, sf_dir):
    return h.outlines(table(spark, sf_dir, "pages"))


@R.add("html_pruned")
def html_pruned(spark, sf_dir):
    return h.pruned(h.outlines(table(spark, sf_dir, "pages")), max_depth=4)


@R.add("a16_dom_nodes")
def a16_dom_nodes(spark, sf_dir):
    """Elements of each page and its greatest depth; the outline is built by a parser, so no SQL."""
    return h.outlines(table(spark, sf_dir, "pages")).groupBy("page_id").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


# --- files and PHP -----------------------------------------------------------

_KEPT_FILES = "WITH f AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'src/a' || p_partkey || '.php' WHEN 1 THEN '.git/x' || p_partkey WHEN 2 THEN 'node_modules/m/i' || p_partkey || '.js' WHEN 3 THEN 'img/p' || p_partkey || '.png' WHEN 4 THEN 'lib/x' || p_partkey || '.min.js' WHEN 5 THEN 'build/o' || p_partkey || '.py' ELSE 'doc/d' || p_partkey || '.md' END AS file_path, p_size * 20000 AS size FROM part)"


def _paths(spark, sf_dir):
    k = F.col("p_partkey")
    name = lambda a, b="": F.concat(F.lit(a), k.cast("string"), F.lit(b))
    cases = [name("src/a", ".php"), name(".git/x"), name("node_modules/m/i", ".js"), name("img/p", ".png"), name("lib/x", ".min.js"), name("build/o", ".py"), name("doc/d", ".md")]
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*cases), (1 + k % 7).cast("int")).alias("file_path"), (F.col("p_size") * 20000).alias("size"))


@R.add("s4_kept_files", f"{_KEPT_FILES} SELECT file_path FROM f WHERE p_partkey % 7 IN (0, 6) AND size <= 512 * 1024")
def s4_kept_files(spark, sf_dir):
    """Paths after size limit, built-in rules and an ignore file that leaves out build/."""
    rows = _paths(spark, sf_dir)
    return rows.filter(files.kept(F.col("file_path"), F.col("size"), rules=files.ignore_rules("# out\nbuild/\n"))).select("file_path")


_NESTED = "(p_partkey % 7 = 6 AND starts_with(p_partkey::VARCHAR, '1') AND NOT starts_with(p_partkey::VARCHAR, '13')) OR (p_partkey % 7 = 5 AND p_partkey % 10 <> 5) OR (p_partkey % 7 = 0 AND ends_with(p_partkey::VARCHAR, '7'))"


@R.add("s6_ignore_by_folder", f"{_KEPT_FILES} SELECT file_path FROM f WHERE NOT ({_NESTED})")
def s6_ignore_by_folder(spark, sf_dir):
    """Paths that the ignore files of the root, of build/ and of doc/ keep; the deeper file's rules win."""
    lists = spark.createDataFrame([(".ignore", "build/\n# comment\n/src/*7.php\nd13*\n"), ("build/.ignore", "!*5.py\n"), ("doc/.ignore", "d1*\n!d13*\n")], "file_path string, text string")
    return files.not_ignored(_paths(spark, sf_dir), files.directory_rules(lists)).select("file_path")


@R.add("s16_listing", f"{_KEPT_FILES} SELECT file_path FROM f WHERE p_partkey % 7 IN (0, 2, 4)")
def s16_listing(spark, sf_dir):
    return files.listing(_paths(spark, sf_dir), include=("*.php", "*.js")).select("file_path")


def _php(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("<?php\nfinal class C"), k, F.lit(" {\n  public static function run"), k, F.lit("() {}\n}\ninterface I"), k, F.lit(" {}\nfunction m"), k, F.lit("_form_alter(&$x) {}\nfunction other() {}"))
    return spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", text.alias("text"), F.concat(F.lit("modules/m"), k, F.lit(".module")).alias("file_path"))


@R.add("v7_php_symbols", "SELECT p_partkey, unnest([2, 3, 5, 6, 7]::BIGINT[]) AS line, unnest(['class', 'function', 'interface', 'function', 'function']) AS kind, unnest(['C' || p_partkey, 'run' || p_partkey, 'I' || p_partkey, 'm' || p_partkey || '_form_alter', 'other']) AS name FROM part")
def v7_php_symbols(spark, sf_dir):
    return ch.php_symbols(_php(spark, sf_dir), "p_partkey")


_KINDS = r"""SELECT p_partkey, unnest([2, 4, 8, 9, 10, 13, 16, 16]::BIGINT[]) AS line, unnest(['event_subscriber', 'form', 'plugin', 'controller', 'drush_command', 'hook', 'hook', 'preprocess']) AS kind,
  unnest(['Sub' || p_partkey, 'Edit', 'Block', 'Page', 'Run', 'm' || p_partkey || '_cron', 'm_preprocess_node', 'm_preprocess_node']) AS name,
  unnest(['class Sub' || p_partkey || ' extends Base' || chr(10) || '  implements EventSubscriberInterface', 'class Edit extends' || chr(10) || chr(10) || '  FormBase', '#[Block(', 'class Page extends ControllerBase', 'class Run extends DrushCommands', 'function m' || p_partkey || '_cron(', 'function m_preprocess_node(', 'function m_preprocess_node(']) AS content FROM part"""


@R.add("v7_php_kinds", _KINDS)
def v7_php_kinds(spark, sf_dir):
    """What the declarations of a PHP file are for, some of them over several lines."""
    k = F.col("p_partkey").cast("string")
    head = F.concat(F.lit("<?php\nclass Sub"), k, F.lit(" extends Base\n  implements EventSubscriberInterface {}\nclass Edit extends\n\n  FormBase {}\n@Not(\n#[Block(id: 1)]\nclass Page extends ControllerBase {}\n"))
    tail = F.concat(F.lit("class Run extends DrushCommands {\n}\n\nfunction m"), k, F.lit("_cron() {}\n  function indented() {}\n\nfunction m_preprocess_node(&$v) {}\n"))
    return ch.php_kinds(table(spark, sf_dir, "part").select("p_partkey", F.concat(head, tail).alias("text"), F.concat(F.lit("modules/m"), k, F.lit(".module")).alias("file_path")), "p_partkey")


@R.add("v8_hooks", "SELECT p_partkey, 6::BIGINT AS line, 'm' || p_partkey AS module, 'form_alter' AS hook FROM part")
def v8_hooks(spark, sf_dir):
    return ch.hooks(_php(spark, sf_dir), "p_partkey")


@R.add("html_excerpt", "SELECT page_id, substr(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), 1, 40) AS excerpt FROM pages")
def html_excerpt(spark, sf_dir):
    """The first characters of each page's title."""
    return h.excerpts(table(spark, sf_dir, "pages"), "title", outer=False, max_chars=40)


@R.add("html_links", """SELECT page_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS place, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>', 0, 's'), 'href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, sf_dir):
    """The links of each page's navigation in their order, by a compound selector."""
    found = h.select(h.elements(table(spark, sf_dir, "pages")), "nav > ul li a[href]")
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("node_id")).cast("long")
    return found.select("page_id", place.alias("place"), F.col("attributes")["href"].alias("href"))
