"""Retrieval queries: filters, vector and keyword legs, fusion, boosts, gap cut, paging, explain, context packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import context as c
from lodestone.operators import retrieval as r
from lodestone.operators import wordindex
from lodestone.operators.scratch import place
from lodestone.plans.base import Registry, table
from lodestone.plans.inputs import CHUNKS_SQL, LINES_SQL, NOW_NS, QUERY_VECTOR, VECTORS_SQL, chunks, turns, vectors

R = Registry()
QUERY = "the onth TheEr2 reading of v1.2 error and tion ANAN"
WORDS, NAMES = t.keywords(QUERY), t.identifiers(QUERY)
_VECTOR = ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR)
_SCOPED = "scoped AS (SELECT * FROM chunks WHERE schema_version = '1.0')"
_DIST = f"round(1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), [{_VECTOR}]), 6)"
_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9_.]+'), lambda x: x <> '')"


def _where(name: str, filters: r.Filters, test: str) -> None:
    @R.add(name, f"WITH {CHUNKS_SQL} SELECT chunk_id, file_path, CAST(n_chars AS BIGINT) AS n_chars FROM chunks WHERE {test}")
    def query(spark, sf_dir):
        return r.scoped(chunks(spark, sf_dir), filters).select("chunk_id", "file_path", "n_chars")


_where("q1_scope", r.Filters(project="src1"), "project_path = 'src1' AND schema_version = '1.0'")
_where("q2_language", r.Filters(language="fr"), "language = 'fr' AND schema_version = '1.0'")
_where("q3_extensions", r.Filters(extensions=("md", ".py")), "(ends_with(file_path, '.md') OR ends_with(file_path, '.py')) AND schema_version = '1.0'")
_where("q4_path_prefix", r.Filters(path_prefix="/src2/"), "starts_with(file_path, '/src2/') AND schema_version = '1.0'")
_where("q5_updated_after", r.Filters(updated_after_ns=NOW_NS - 90 * 3_600_000_000_000), f"mtime_ns >= {NOW_NS - 90 * 3_600_000_000_000} AND schema_version = '1.0'")
_where("q6_symbol", r.Filters(equal={"class_name": "Class3", "function_name": "fn_3"}), "class_name = 'Class3' AND function_name = 'fn_3' AND schema_version = '1.0'")
_where("q7_tags", r.Filters(tags=("es", "src3")), "list_has_any(tags, ['es', 'src3']) AND schema_version = '1.0'")


@R.add("r5_cosine_distance", f"WITH {VECTORS_SQL} SELECT chunk_id, {_DIST} AS distance FROM vectors")
def r5_cosine_distance(spark, sf_dir):
    return vectors(spark, sf_dir).select("chunk_id", F.round(r.cosine_distance(F.col("vector"), QUERY_VECTOR), 6).alias("distance"))


_NEAR = f"near AS (SELECT chunk_id, file_path, {_DIST} AS distance FROM scoped JOIN vectors USING (chunk_id) ORDER BY distance, chunk_id LIMIT 50)"


@R.add("o1_vector_top_k", f"WITH {CHUNKS_SQL}, {VECTORS_SQL}, {_SCOPED}, {_NEAR} SELECT * FROM near")
def o1_vector_top_k(spark, sf_dir):
    rows = r.scoped(chunks(spark, sf_dir), r.Filters()).join(vectors(spark, sf_dir), "chunk_id")
    return r.vector_top_k(rows, QUERY_VECTOR).select("chunk_id", "file_path", "distance")


@R.add("s9_point_lookup", f"WITH {CHUNKS_SQL} SELECT chunk_id, project_path, text FROM chunks WHERE chunk_id = '17'")
def s9_point_lookup(spark, sf_dir):
    return chunks(spark, sf_dir).filter("chunk_id = '17'").select("chunk_id", "project_path", "text")


@R.add("s10_vector_lookup", f"WITH {VECTORS_SQL} SELECT chunk_id, CAST(len(vector) AS BIGINT) AS dim, round(list_sum(CAST(vector AS DOUBLE[])), 4) AS total FROM vectors WHERE chunk_id = '17'")
def s10_vector_lookup(spark, sf_dir):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors(spark, sf_dir).filter("chunk_id = '17'").select("chunk_id", F.size("vector").cast("long").alias("dim"), F.round(total, 4).alias("total"))


@R.add("a17_corpus_stats", f"WITH {CHUNKS_SQL}, tok AS (SELECT chunk_id, unnest({_TOKENS}) AS term FROM chunks) SELECT term, CAST(count(DISTINCT chunk_id) AS BIGINT) AS df, CAST(count(*) AS BIGINT) AS cf FROM tok GROUP BY term")
def a17_corpus_stats(spark, sf_dir):
    """Document and collection frequency of every term."""
    held = chunks(spark, sf_dir).select("chunk_id", F.explode(t.tokens(F.col("text"))).alias("term"))
    return held.groupBy("chunk_id", "term").agg(F.count("*").alias("tf")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@R.add("k13_postings", f"WITH {CHUNKS_SQL}, tok AS (SELECT chunk_id, unnest({_TOKENS}) AS term FROM chunks) SELECT term, chunk_id, CAST(count(*) AS BIGINT) AS tf FROM tok GROUP BY term, chunk_id")
def k13_postings(spark, sf_dir):
    """The inverted index: how often each term occurs in each chunk."""
    return chunks(spark, sf_dir).select("chunk_id", F.explode(t.tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))


_TERMS = ", ".join(f"'{w}'" for w in WORDS)
_BM25 = f"""
held AS (SELECT *, {_TOKENS} AS toks FROM scoped),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM held),
df AS (SELECT w, (SELECT count(*) FROM held WHERE list_contains(toks, w)) AS df FROM (SELECT unnest([{_TERMS}]) AS w)),
words AS (
  SELECT chunk_id, round(score, 6) AS score FROM (
    SELECT chunk_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(toks) / mean))) AS score
    FROM (SELECT chunk_id, toks, w, df, CAST(len(list_filter(toks, lambda x: x = w)) AS DOUBLE) AS tf FROM held, df), stats GROUP BY chunk_id)
  WHERE score > 0
), top_words AS (SELECT * FROM words WHERE score > 0 ORDER BY score DESC, chunk_id LIMIT 50)"""


@R.add("r6_bm25", f"WITH {CHUNKS_SQL}, {_SCOPED}, {_BM25} SELECT chunk_id, score FROM words WHERE score > 0")
def r6_bm25(spark, sf_dir):
    return r.bm25(r.scoped(chunks(spark, sf_dir), r.Filters()), WORDS).select("chunk_id", "score")


@R.add("o2_keyword_top_k", f"WITH {CHUNKS_SQL}, {_SCOPED}, {_BM25} SELECT chunk_id, score FROM top_words")
def o2_keyword_top_k(spark, sf_dir):
    return r.keyword_top_k(r.scoped(chunks(spark, sf_dir), r.Filters()), QUERY).select("chunk_id", "score")


@R.add("o2_indexed_top_k", f"WITH {CHUNKS_SQL}, {_SCOPED}, {_BM25} SELECT chunk_id, score FROM top_words")
def o2_indexed_top_k(spark, sf_dir):
    """The same from a stored word index: only postings of the query's words are read, and scored where they can be among the best.

    Half of the chunks come in a second segment, and those of another version come first and go again.
    """
    every = chunks(spark, sf_dir)
    rows = r.scoped(every, r.Filters())
    index = wordindex.WordIndex(spark, place(spark, "words"))
    half = F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0
    index.change(every.filter(half))
    index.change(rows.filter(~half), every.filter("schema_version <> '1.0'").select("chunk_id"))
    return index.top_k(QUERY, r.CANDIDATES)


_FUSED = f"""
a AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS vector_rank FROM near),
b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS keyword_rank FROM top_words),
fused AS (
  SELECT chunk_id, vector_rank, keyword_rank, coalesce({r.ALPHA}::DOUBLE / (60.0::DOUBLE + vector_rank), 0) + coalesce({1 - r.ALPHA}::DOUBLE / (60.0::DOUBLE + keyword_rank), 0) AS fused
  FROM a FULL OUTER JOIN b USING (chunk_id)
)"""
_LEGS = f"{CHUNKS_SQL}, {VECTORS_SQL}, {_SCOPED}, {_NEAR}, {_BM25}"


@R.add("r1_rank_fusion", f"WITH {_LEGS}, {_FUSED} SELECT chunk_id, vector_rank, keyword_rank, round(fused, 9) AS score FROM fused")
def r1_rank_fusion(spark, sf_dir):
    rows = r.scoped(chunks(spark, sf_dir), r.Filters())
    near = r.vector_top_k(rows.join(vectors(spark, sf_dir), "chunk_id"), QUERY_VECTOR)
    return r.fuse(r.ranked(near, "distance", "chunk_id"), r.ranked(r.keyword_top_k(rows, QUERY), F.desc("score"), "chunk_id")).withColumn("score", F.round("score", 9))


_BOOST = " + ".join(f"CASE WHEN {t.whole_word_sql('text', n)} THEN 0.15::DOUBLE ELSE 0 END" for n in NAMES)


@R.add("r2_identifier_boost", f"WITH {CHUNKS_SQL} SELECT chunk_id, round(least({_BOOST}, 0.3::DOUBLE), 6) AS boost FROM chunks")
def r2_identifier_boost(spark, sf_dir):
    return r.boosted(chunks(spark, sf_dir).withColumn("score", F.lit(0.0)), NAMES).select("chunk_id", F.round("boost", 6).alias("boost"))


def _hybrid_sql(gap: float, fused: str = _FUSED) -> str:
    return f"""WITH {_LEGS}, {fused}, lifted AS (
  SELECT chunk_id, file_path, mtime_ns, vector_rank, keyword_rank, fused, least({_BOOST}, 0.3::DOUBLE) AS boost FROM fused JOIN scoped USING (chunk_id)
), first_order AS (SELECT *, fused + boost AS s, row_number() OVER (ORDER BY fused + boost DESC, chunk_id) AS k FROM lifted),
aged AS (
  SELECT *, round(CASE WHEN k <= 50 AND mtime_ns IS NOT NULL THEN s * (1 + 0.1::DOUBLE * exp(-greatest(0, ({NOW_NS} - mtime_ns) / 86400000000000.0::DOUBLE) / 30)) ELSE s END, 9) AS score FROM first_order
), stepped AS (
  SELECT *, row_number() OVER w AS rank, lag(score) OVER w - score AS step, first_value(score) OVER w AS top FROM aged WINDOW w AS (ORDER BY score DESC, chunk_id)
), cut AS (SELECT *, sum(CASE WHEN {gap}::DOUBLE > 0 AND top > 0 AND step > {gap}::DOUBLE * top THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS cuts FROM stepped)
SELECT rank, chunk_id, file_path, vector_rank, keyword_rank, round(fused, 9) AS fused, boost, score FROM cut WHERE cuts = 0"""


def hybrid(spark, sf_dir, gap=r.GAP):
    return r.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), QUERY, QUERY_VECTOR, r.Filters(), NOW_NS, gap=gap)


@R.add("search_hybrid", _hybrid_sql(r.GAP))
def search_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir)


@R.add("search_hybrid_page", f"SELECT *, count(*) OVER () AS total, count(*) OVER () > 25 AS has_more FROM ({_hybrid_sql(0.0)}) QUALIFY rank > 10 AND rank <= 25".replace("SELECT *, count(*) OVER () AS total", "SELECT * FROM (SELECT *, count(*) OVER () AS total", 1).replace("QUALIFY", ") WHERE", 1))
def search_hybrid_page(spark, sf_dir):
    return r.page(hybrid(spark, sf_dir, gap=0.0), limit=15, offset=10)


def _far_sql() -> str:
    return _hybrid_sql(0.0).replace("LIMIT 50", "LIMIT 75")


@R.add("search_hybrid_far_page", f"SELECT * FROM ({_far_sql()}) WHERE rank > 60 AND rank <= 75")
def search_hybrid_far_page(spark, sf_dir):
    """A page from the 61st result on: the legs give as many candidates as it takes."""
    found = r.hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), QUERY, QUERY_VECTOR, r.Filters(), NOW_NS, gap=0.0, candidates=75)
    return r.page(found, limit=15, offset=60).drop("total", "has_more")


@R.add("search_hybrid_deep", _hybrid_sql(r.GAP).replace("LIMIT 50", "LIMIT 400"))
def search_hybrid_deep(spark, sf_dir):
    """Legs of 400 candidates as those of any number are ranked and fused: by ranges and shuffles."""
    return r.deep_hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), QUERY, QUERY_VECTOR, r.Filters(), NOW_NS, candidates=400)


@R.add("search_hybrid_deep_page", f"SELECT * FROM ({_hybrid_sql(0.0).replace('LIMIT 50', 'LIMIT 400')}) WHERE rank > 380 AND rank <= 400")
def search_hybrid_deep_page(spark, sf_dir):
    found = r.deep_hybrid(chunks(spark, sf_dir), vectors(spark, sf_dir), QUERY, QUERY_VECTOR, r.Filters(), NOW_NS, candidates=400, gap=0.0)
    return r.page(found, limit=20, offset=380).drop("total", "has_more")


@R.add("search_semantic", f"WITH {_LEGS} SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM near")
def search_semantic(spark, sf_dir):
    return r.hybrid(chunks(spark, sf_dir).drop("mtime_ns").withColumn("mtime_ns", F.lit(None).cast("long")), vectors(spark, sf_dir), "", QUERY_VECTOR, r.Filters(), NOW_NS, alpha=1.0, gap=0.0).select("chunk_id", "rank")


@R.add("search_keyword", f"WITH {_LEGS} SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM top_words")
def search_keyword(spark, sf_dir):
    found = r.hybrid(chunks(spark, sf_dir).drop("mtime_ns").withColumn("mtime_ns", F.lit(None).cast("long")), vectors(spark, sf_dir), " ".join(WORDS).lower(), QUERY_VECTOR, r.Filters(), NOW_NS, alpha=0.0, gap=0.0)
    return found.select("chunk_id", F.row_number().over(r.Window.orderBy("keyword_rank")).cast("long").alias("rank"))


@R.add("explain_match", _hybrid_sql(0.0).replace("WHERE cuts = 0", "WHERE chunk_id = (SELECT max(chunk_id) FROM near)"))
def explain_match(spark, sf_dir):
    """Where one chunk stands among the candidates, and why; here the last id of the vector leg."""
    rows = r.scoped(chunks(spark, sf_dir), r.Filters())
    wanted = r.vector_top_k(rows.join(vectors(spark, sf_dir), "chunk_id"), QUERY_VECTOR).agg(F.max("chunk_id").alias("chunk_id"))
    return hybrid(spark, sf_dir, gap=0.0).join(wanted, "chunk_id", "left_semi")


@R.add("search_similar", f"WITH {CHUNKS_SQL}, {VECTORS_SQL}, seed AS (SELECT vector AS q FROM vectors WHERE chunk_id = '17') SELECT chunk_id, file_path, round(1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS distance FROM chunks JOIN vectors USING (chunk_id), seed WHERE chunk_id <> '17' ORDER BY distance, chunk_id LIMIT 10")
def search_similar(spark, sf_dir):
    return r.similar(chunks(spark, sf_dir), vectors(spark, sf_dir), "17")


_LIKE = " + ".join(
    f"(CASE WHEN contains(x, '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(p, '{w}') THEN 5 ELSE 0 END + CASE WHEN contains(f, '{w}') OR contains(c, '{w}') THEN 3 ELSE 0 END + CASE WHEN f = '{w}' OR c = '{w}' THEN 10 ELSE 0 END + CASE WHEN ends_with(p, '/{w}') OR p = '{w}' OR regexp_extract(p, '/([^/]*)\\.[a-z0-9]+$', 1) = '{w}' THEN 10 ELSE 0 END)"
    for w in t.terms("fn_7 class2 17 tion")
)
_LIKE_MATCH = " OR ".join(f"contains(x, '{w}') OR contains(p, '{w}') OR contains(f, '{w}') OR contains(c, '{w}')" for w in t.terms("fn_7 class2 17 tion"))
_LOW = f"WITH {CHUNKS_SQL}, low AS (SELECT chunk_id, lower(coalesce(text, '')) AS x, lower(file_path) AS p, lower(function_name) AS f, lower(class_name) AS c FROM chunks)"


@R.add("r7_like_score", f"{_LOW} SELECT chunk_id, CAST({_LIKE} AS BIGINT) AS score FROM low WHERE {_LIKE_MATCH}")
def r7_like_score(spark, sf_dir):
    return r.like_score(chunks(spark, sf_dir), "fn_7 class2 17 tion").select("chunk_id", "score")


@R.add("o4_like_top_k", f"{_LOW} SELECT chunk_id, CAST({_LIKE} AS BIGINT) AS score FROM low WHERE {_LIKE_MATCH} ORDER BY score DESC, chunk_id LIMIT 20")
def o4_like_top_k(spark, sf_dir):
    return r.like_score(chunks(spark, sf_dir), "fn_7 class2 17 tion").select("chunk_id", "score").orderBy(F.desc("score"), "chunk_id").limit(20)


# --- context -----------------------------------------------------------------

_NEIGHBORS = f"""WITH {LINES_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS rn FROM lines),
wanted AS (SELECT file_path AS f, rn AS spot, chunk_id AS target FROM placed)
SELECT target, chunk_id, rn - spot AS hop FROM wanted JOIN placed ON file_path = f AND rn BETWEEN spot - 2 AND spot + 1"""


@R.add("w2_neighbors", _NEIGHBORS)
def w2_neighbors(spark, sf_dir):
    """The two chunks before and the one after every chunk, in one join."""
    rows = turns(spark, sf_dir)
    return c.neighbors(rows, rows.select("chunk_id"), before=2, after=1).select("target", "chunk_id", "hop")


def _pack_sql(strategy: str) -> str:
    cut = {"head": "substr(text, 1, room) || ' …'", "tail": "'… ' || right(text, room)", "middle": "CASE WHEN room <= 3 THEN substr(text, 1, room) ELSE substr(text, 1, (room - 2) // 2) || chr(10) || '…' || chr(10) || CASE WHEN (room - 3) // 2 > 0 THEN right(text, (room - 3) // 2) ELSE '' END END"}[strategy]
    return f"""WITH {LINES_SQL}, hits AS (SELECT *, len({_TOKENS}) AS n FROM lines),
top AS (SELECT *, row_number() OVER (ORDER BY n DESC, chunk_id) AS rank FROM (SELECT * FROM hits ORDER BY n DESC, chunk_id LIMIT 30)),
files AS (SELECT file_path, min(rank) AS first FROM top GROUP BY file_path QUALIFY row_number() OVER (ORDER BY min(rank)) <= 8),
primaries AS (SELECT top.* FROM top JOIN files USING (file_path)),
placed AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY start_line, chunk_id) AS rn FROM lines),
around AS (
  SELECT p.rank, CASE WHEN q.rn = o.rn THEN 0 WHEN q.rn < o.rn THEN 1 ELSE 2 END AS side, q.* FROM primaries p JOIN placed o ON o.chunk_id = p.chunk_id JOIN placed q ON q.file_path = o.file_path AND q.rn BETWEEN o.rn - 1 AND o.rn + 1
), once AS (SELECT * FROM around QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY rank, side, rn) = 1),
run AS (SELECT *, coalesce(sum(length(text)) OVER (ORDER BY rank, side, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM once),
fit AS (SELECT *, CAST(12000 - before AS BIGINT) AS room FROM run WHERE before < 12000)
SELECT file_path, start_line, chunk_id, rank, CASE WHEN length(text) <= room THEN text ELSE {cut} END AS excerpt, length(text) > room AS cut FROM fit"""


def _pack(name: str, strategy: str) -> None:
    @R.add(name, _pack_sql(strategy))
    def query(spark, sf_dir):
        """The longest turns stand for ranked hits; at most 8 files and 12000 characters with their neighbours."""
        rows = turns(spark, sf_dir)
        top = rows.withColumn("n", F.size(t.tokens(F.col("text")))).orderBy(F.desc("n"), "chunk_id").limit(30)
        hits = top.withColumn("rank", F.row_number().over(r.Window.orderBy(F.desc("n"), "chunk_id")).cast("long"))
        return c.pack(rows, hits, max_files=8, max_chars=12_000, hops=1, keep=strategy)


for _s in ("middle", "head", "tail"):
    _pack(f"v10_context_pack_{_s}", _s)


@R.add("get_chunk", f"WITH {CHUNKS_SQL} SELECT chunk_id, file_path, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 39) || chr(10) || '…' || chr(10) || right(text, 38) END AS text FROM chunks WHERE chunk_id = '21'")
def get_chunk(spark, sf_dir):
    return chunks(spark, sf_dir).filter("chunk_id = '21'").select("chunk_id", "file_path", t.truncate(F.col("text"), 80).alias("text"))


@R.add("s12_file_chunks", f"WITH {LINES_SQL} SELECT chunk_id, start_line, text FROM lines WHERE file_path = '7' OR ends_with(file_path, '13') ORDER BY file_path, start_line LIMIT 200")
def s12_file_chunks(spark, sf_dir):
    rows = turns(spark, sf_dir).filter((F.col("file_path") == "7") | F.col("file_path").endswith("13"))
    return rows.orderBy("file_path", "start_line").limit(200).select("chunk_id", "start_line", "text")


@R.add("o12_rerank", f"WITH {CHUNKS_SQL}, {_SCOPED}, {_BM25}, b AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM top_words), o AS (SELECT unnest([5, 1, 3]) AS rank, unnest([1, 2, 3]) AS pos) SELECT chunk_id, rank, row_number() OVER (ORDER BY CASE WHEN rank > 20 THEN 1 ELSE 0 END, pos NULLS LAST, rank) AS reranked FROM b LEFT JOIN o USING (rank)")
def o12_rerank(spark, sf_dir):
    rows = r.keyword_top_k(r.scoped(chunks(spark, sf_dir), r.Filters()), QUERY)
    ranked = r.ranked(rows, F.desc("score"), "chunk_id")
    return c.rerank(ranked, c.parse_order("Best first: [5, 1, 5, 3, 99]", 20))


@R.add("q_documents_by_language", "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY lang")
def documents_by_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
