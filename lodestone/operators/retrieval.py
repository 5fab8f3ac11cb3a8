"""Filtered vector and keyword search, rank fusion, boosts, gap cut and paging.

Legs end in a top-k, so what is fused, boosted and cut afterwards is a hundred
rows at most; the windows without a partition run on those alone.  Every sort
ends in the chunk's id.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as t
from lodestone.operators.scratch import written

# Fusion weight and offset, boosts, recency and gap.
ALPHA, RRF_K, CANDIDATES = 0.65, 60, 50
BOOST, BOOST_CAP = 0.15, 0.30
RECENCY_WEIGHT, RECENCY_DAYS, RECENCY_ROWS = 0.1, 30.0, 50
GAP = 0.25
K1, B = 1.2, 0.75
DAY_NS = 86_400_000_000_000.0


@dataclass(frozen=True)
class Filters:
    """Metadata predicates; those left empty don't apply."""

    project: str | None = None
    version: str | None = "1.0"
    language: str | None = None
    extensions: tuple[str, ...] = ()
    path_prefix: str | None = None
    updated_after_ns: int | None = None
    tags: tuple[str, ...] = ()
    equal: dict[str, str] = field(default_factory=dict)


def scoped(chunks: DataFrame, f: Filters) -> DataFrame:
    """Rows that meet all predicates; they reach the scan, before any ranking."""
    tests: list[Column] = []
    if f.project is not None:
        tests.append(F.col("project_path") == f.project)
    if f.version is not None:
        tests.append(F.col("schema_version") == f.version)
    if f.language is not None:
        tests.append(F.col("language") == f.language)
    if f.extensions:
        ends = [F.col("file_path").endswith(e if e.startswith(".") else f".{e}") for e in f.extensions]
        test = ends[0]
        for e in ends[1:]:
            test = test | e
        tests.append(test)
    if f.path_prefix is not None:
        tests.append(F.col("file_path").startswith(f.path_prefix))
    if f.updated_after_ns is not None:
        tests.append(F.col("mtime_ns") >= f.updated_after_ns)
    if f.tags:
        tests.append(F.arrays_overlap("tags", F.array(*map(F.lit, f.tags))))
    tests += [F.col(k) == v for k, v in f.equal.items()]
    for test in tests:
        chunks = chunks.filter(test)
    return chunks


# --- legs --------------------------------------------------------------------


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cos; null for a zero vector or one of another length. The query is a literal, its norm computed once."""
    norm = sum(x * x for x in query) ** 0.5
    q = F.array(*map(F.lit, map(float, query)))
    own = F.sqrt(_dot(vector, vector))
    return F.when(F.size(vector) == len(query), 1 - _dot(vector, q) / F.nullif(own * F.lit(norm), F.lit(0.0)))


def vector_top_k(rows: DataFrame, query: list[float], k: int = CANDIDATES) -> DataFrame:
    """The k nearest rows by cosine distance, rounded before it ranks."""
    return rows.withColumn("distance", F.round(cosine_distance(F.col("vector"), query), 6)).filter("distance is not null").orderBy("distance", "chunk_id").limit(k)


def _hits(words: list[str]) -> Column:
    """The query's words in a text, in one pass: all their occurrences, few whatever the text's length."""
    some = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    return F.regexp_extract_all(_lower(), F.lit(f"(?<![a-z0-9_.])(?:{some})(?![a-z0-9_.])"), F.lit(0))


def _lower() -> Column:
    return F.lower(F.coalesce(F.col("text"), F.lit("")))


def _length() -> Column:
    return F.regexp_count(_lower(), F.lit("[a-z0-9_.]+"))


def bm25(rows: DataFrame, words: list[str]) -> DataFrame:
    """(chunk_id, score) of the rows that hold any of the words.

    One pass over the texts: the rows' number and their words are observed on the
    way, and of the rows that hold a word, id, length and counts are written.
    """
    if not words:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).filter(F.lit(False))
    seen = Observation()
    texts = rows.select("chunk_id", _length().alias("_n"), _hits(words).alias("_h")).observe(seen, F.count(F.lit(1)).alias("rows"), F.sum("_n").alias("words"))
    counts = F.array(*(F.size("_h") - F.size(F.array_remove("_h", w)) for w in words))
    held = written(texts.filter(F.size("_h") > 0).select("chunk_id", "_n", counts.alias("_tf")), "held")
    n, total = seen.get["rows"], seen.get["words"] or 0
    df = held.agg(*(F.count_if(F.col("_tf")[i] > 0).alias(f"_{i}") for i in range(len(words)))).first()
    score, relative = F.lit(0.0), F.col("_n") / F.lit(total / n if total else 1.0)
    for i in range(len(words)):
        idf = math.log(1 + (n - df[i] + 0.5) / (df[i] + 0.5))
        tf = F.col("_tf")[i].cast("double")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + B * relative))
    return held.select("chunk_id", F.round(score, 6).alias("score"))


def keyword_top_k(rows: DataFrame, query: str, k: int = CANDIDATES) -> DataFrame:
    """The k best rows (chunk_id, score) by their words."""
    return bm25(rows, t.keywords(query)).orderBy(F.desc("score"), "chunk_id").limit(k)


def like_score(rows: DataFrame, query: str) -> DataFrame:
    """Adds ``score`` by where a query's terms occur: text 1, path 5, names 3, exact names or file names 10 more."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text, path, function, cls = low("text"), low("file_path"), low("function_name"), low("class_name")
    score, match = F.lit(0), F.lit(False)
    for w in t.terms(query):
        exact_path = path.endswith(f"/{w}") | (path == w) | F.regexp_extract(path, r"/([^/]*)\.[a-z0-9]+$", 1).eqNullSafe(w)
        for test, points in ((text.contains(w), 1), (path.contains(w), 5), (function.contains(w) | cls.contains(w), 3), ((function == w) | (cls == w), 10), (exact_path, 10)):
            score = score + F.when(test, points).otherwise(0)
        match = match | text.contains(w) | path.contains(w) | function.contains(w) | cls.contains(w)
    return rows.withColumn("score", score.cast("long")).filter(match)


# --- fusion ------------------------------------------------------------------


def ranked(leg: DataFrame, *order: Column | str) -> DataFrame:
    """(chunk_id, rank) of a leg that a limit has already bounded."""
    return leg.select("chunk_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def fuse(vector: DataFrame, keyword: DataFrame, alpha: float = ALPHA, k: int = RRF_K) -> DataFrame:
    """(chunk_id, vector_rank, keyword_rank, score): weighted reciprocal ranks, a missing leg counting 0."""
    both = vector.withColumnRenamed("rank", "vector_rank").join(keyword.withColumnRenamed("rank", "keyword_rank"), "chunk_id", "full_outer")
    part = lambda rank, weight: F.coalesce(F.lit(weight) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    return both.withColumn("score", part("vector_rank", alpha) + part("keyword_rank", 1 - alpha))


def boosted(rows: DataFrame, identifiers: list[str]) -> DataFrame:
    """Adds ``boost`` and adds it to the score: a share for each identifier in the text as a whole word, up to a cap."""
    hits = F.lit(0.0)
    for name in identifiers:
        hits = hits + F.when(t.whole_word(F.coalesce("text", F.lit("")), name), BOOST).otherwise(0.0)
    return rows.withColumn("boost", F.least(hits, F.lit(BOOST_CAP))).withColumn("score", F.col("score") + F.col("boost"))


def recent(rows: DataFrame, now_ns: int, weight: float = RECENCY_WEIGHT) -> DataFrame:
    """Multiplies the score of the best rows by 1 + weight * exp(-age / 30 days); no time, no change."""
    age = F.greatest(F.lit(0.0), (F.lit(now_ns) - F.col("mtime_ns")) / F.lit(DAY_NS))
    factor = F.when((F.col("_r") <= RECENCY_ROWS) & F.col("mtime_ns").isNotNull(), 1 + F.lit(weight) * F.exp(-age / F.lit(RECENCY_DAYS))).otherwise(1.0)
    return rows.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).withColumn("score", F.col("score") * factor).drop("_r")


def gap_cut(rows: DataFrame, threshold: float = GAP) -> DataFrame:
    """The prefix before the first step down of more than threshold times the top score, and each row's ``rank``."""
    order = Window.orderBy(F.desc("score"), "chunk_id")
    step = F.lag("score").over(order) - F.col("score")
    top = F.first("score").over(order)
    cut = (F.lit(threshold) > 0) & (top > 0) & (step > F.lit(threshold) * top)
    marked = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("_cut", F.when(cut, 1).otherwise(0))
    return marked.withColumn("_cuts", F.sum("_cut").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).filter("_cuts = 0").drop("_cut", "_cuts")


def like_top_k(rows: DataFrame, query: str, k: int = CANDIDATES) -> DataFrame:
    """The k best rows (chunk_id, score) by terms."""
    return like_score(rows, query).select("chunk_id", F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(k)


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit of a ranked result, with its total (its last rank) and whether more follow."""
    total = F.lit(rows.agg(F.max("rank")).first()[0] or 0).cast("long")
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit).filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], filters: Filters, now_ns: int, alpha: float = ALPHA, k: int = RRF_K, weight: float = RECENCY_WEIGHT, gap: float = GAP, candidates: int = CANDIDATES, leg: Callable[[DataFrame, str, int], DataFrame] | None = None) -> DataFrame:
    """Ranked results of both legs: rank, chunk_id, score and its parts. alpha 1 skips the keyword leg, 0 the vector leg.

    Each leg gives its best ``candidates``: a page that ends beyond them needs more.  ``leg`` stands in for the
    scan of all texts, such as a search in a stored word index.
    """
    rows = scoped(chunks, filters)
    near = vector_top_k(rows.join(vectors, "chunk_id").select("chunk_id", "vector"), vector, candidates)
    words = (leg or keyword_top_k)(rows, query, candidates)
    a = ranked(near if alpha > 0 else near.filter(F.lit(False)), "distance", "chunk_id")
    b = ranked(words if alpha < 1 else words.filter(F.lit(False)), F.desc("score"), "chunk_id")
    fused = fuse(a, b, alpha, k).withColumn("fused", F.round("score", 9))
    full = rows.select("chunk_id", "file_path", "text", "mtime_ns").join(F.broadcast(fused), "chunk_id")  # two legs of as many rows as there are candidates
    best = recent(boosted(full, t.identifiers(query)), now_ns, weight).withColumn("score", F.round("score", 9))
    return gap_cut(best, gap).select("rank", "chunk_id", "file_path", "vector_rank", "keyword_rank", "fused", "boost", "score")


def similar(chunks: DataFrame, vectors: DataFrame, seed: str, k: int = 10) -> DataFrame:
    """The k chunks nearest to one chunk's vector, without itself."""
    found = vectors.filter(F.col("chunk_id") == seed).select("vector").first()
    if found is None:
        return chunks.select("chunk_id", "file_path", F.lit(0.0).alias("distance")).limit(0)
    others = chunks.join(vectors, "chunk_id").filter(F.col("chunk_id") != seed)
    return vector_top_k(others, [float(x) for x in found["vector"]], k).select("chunk_id", "file_path", "distance")


# --- pages far beyond the first candidates -------------------------------------

#: Candidates up to which legs are broadcast and ranked in one task.
DEEP = 10_000


def ranks(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The rows, written, with ``rank`` (from 1) in an order without ties: range partitions are sorted each for itself, and start where the counts of those before end.

    No task holds more than a partition; the driver gets a count for each.
    """
    placed = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = {r["_range"]: r["count"] for r in placed.groupBy("_range").count().collect()}
    starts, total = [], 0
    for k in sorted(counts):
        starts.append((k, total))
        total += counts[k]
    heads = placed.sparkSession.createDataFrame(starts, "_range int, _start long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(heads), "_range").withColumn("rank", F.col("_start") + inside).drop("_range", "_start")  # a row a partition


def deep_hybrid(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], filters: Filters, now_ns: int, candidates: int, alpha: float = ALPHA, k: int = RRF_K, weight: float = RECENCY_WEIGHT, gap: float = GAP, leg: Callable[[DataFrame, str, int], DataFrame] | None = None) -> DataFrame:
    """The same as ``hybrid`` for any number of candidates: legs are ranked by ranges, fused and joined by shuffles.

    Nothing that grows with the candidates is broadcast, collected or put in one partition.
    """
    rows = scoped(chunks, filters)
    empty = rows.select("chunk_id", F.lit(0).cast("long").alias("rank")).filter(F.lit(False))
    a = b = empty
    if alpha > 0:
        near = rows.select("chunk_id").join(vectors, "chunk_id").select("chunk_id", F.round(cosine_distance(F.col("vector"), vector), 6).alias("distance")).filter("distance is not null")
        a = ranks(near, "distance", "chunk_id").filter(F.col("rank") <= candidates).select("chunk_id", "rank")
    if alpha < 1:
        words = leg(rows, query, candidates) if leg else bm25(rows, t.keywords(query))
        b = ranks(words, F.desc("score"), "chunk_id").filter(F.col("rank") <= candidates).select("chunk_id", "rank")
    fused = fuse(a, b, alpha, k).withColumn("fused", F.round("score", 9))
    full = rows.select("chunk_id", "file_path", "text", "mtime_ns").join(fused, "chunk_id")
    best = written(boosted(full, t.identifiers(query)).drop("text"), "boosted")
    order = F.desc("score"), "chunk_id"
    fresh = recent(best.orderBy(*order).limit(RECENCY_ROWS), now_ns, weight).select("chunk_id", F.col("score").alias("_recent"))
    scored = best.join(F.broadcast(fresh), "chunk_id", "left").withColumn("score", F.round(F.coalesce("_recent", "score"), 9))  # RECENCY_ROWS rows
    placed = written(ranks(scored, *order), "placed")
    if gap > 0:
        after = placed.select((F.col("rank") - 1).alias("rank"), F.col("score").alias("_after"))
        top = placed.agg(F.max("score")).first()[0] or 0.0
        cut = placed.select("rank", "score").join(after, "rank").filter((F.lit(top) > 0) & (F.col("score") - F.col("_after") > F.lit(gap * top))).agg(F.min("rank")).first()[0]
        placed = placed.filter(F.col("rank") <= cut) if cut is not None else placed
    return placed.select("rank", "chunk_id", "file_path", "vector_rank", "keyword_rank", "fused", "boost", "score")
