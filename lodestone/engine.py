"""One object over an index's tables: searches, context, graph and diagnostics by name.

What is missing degrades a search instead of failing it: without vectors or an
embedder only keywords count, without an index the queue is searched by terms.
Results are DataFrames in an ``Envelope``, whose counts are only taken if asked.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import context, graph, retrieval
from lodestone.operators.retrieval import ALPHA, GAP, RECENCY_WEIGHT, RRF_K, Filters
from lodestone.operators.wordindex import WordIndex

# Results kept, and for how many seconds; most rows of a page.
CACHE_ROWS, CACHE_SECONDS, MOST = 128, 60.0, 50


@dataclass
class Envelope:
    """A page of results. ``found`` is the whole ranked result, as many rows as there are candidates at most.

    It is collected once, when first asked for; of one of more than ``retrieval.DEEP`` rows only the page is.
    """

    found: DataFrame
    mode: str
    alpha: float
    warnings: list[str] = field(default_factory=list)
    limit: int = MOST
    offset: int = 0

    @cached_property
    def _all(self) -> list:
        return sorted(self.found.collect(), key=lambda r: r["rank"])

    @property
    def rows(self) -> DataFrame:
        """The page as a DataFrame."""
        return retrieval.page(self.found, self.limit, self.offset)

    @property
    def _deep(self) -> bool:
        return self.offset + self.limit > retrieval.DEEP

    @property
    def page(self) -> list:
        if self._deep:
            return sorted(self.found.filter((F.col("rank") > self.offset) & (F.col("rank") <= self.offset + self.limit)).collect(), key=lambda r: r["rank"])
        return self._all[self.offset : self.offset + self.limit]

    @property
    def total(self) -> int:
        return self.found.count() if self._deep else len(self._all)

    @property
    def has_more(self) -> bool:
        return self.total > self.offset + self.limit


class ResultCache:
    """The latest pages by a hash of what was asked; entries age out and the least used go first."""

    def __init__(self, rows: int = CACHE_ROWS, seconds: float = CACHE_SECONDS, clock: Callable[[], float] = time.monotonic):
        self.rows, self.seconds, self.clock = rows, seconds, clock
        self.held: OrderedDict[str, tuple[float, Envelope]] = OrderedDict()

    @staticmethod
    def key(**asked) -> str:
        return hashlib.sha256(json.dumps(asked, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, key: str) -> Envelope | None:
        found = self.held.get(key)
        if not found or self.clock() - found[0] > self.seconds:
            self.held.pop(key, None)
            return None
        self.held.move_to_end(key)
        return found[1]

    def put(self, key: str, value: Envelope) -> None:
        self.held[key] = (self.clock(), value)
        self.held.move_to_end(key)
        while len(self.held) > self.rows:
            self.held.popitem(last=False)


def mode_of(alpha: float, vectors: bool, words: bool) -> str:
    """What a search was in the end."""
    if not vectors and not words:
        return "terms_only"
    if not vectors or alpha <= 0:
        return "keyword_only"
    if not words or alpha >= 1:
        return "semantic_only"
    return "hybrid"


@dataclass
class Engine:
    """chunks (and vectors) of an index, the queue behind it, and a code graph, any of which may be missing."""

    chunks: DataFrame | None = None
    vectors: DataFrame | None = None
    queue: DataFrame | None = None
    nodes: DataFrame | None = None
    edges: DataFrame | None = None
    words: WordIndex | None = None
    embed: Callable[[str], list[float]] | None = None
    now_ns: Callable[[], int] = time.time_ns
    cache: ResultCache = field(default_factory=ResultCache)
    #: Names the state of the tables: results held under another one are not given again.
    version: str = ""
    #: Whether the chunks' words can be searched; if not, terms stand in for them.
    searchable: bool = True

    def _state(self) -> list:
        return [self.version, self.searchable, *(x.semanticHash() if x is not None else None for x in (self.chunks, self.vectors, self.queue))]

    def search(self, query: str, alpha: float = ALPHA, limit: int = 10, offset: int = 0, filters: Filters = Filters(), k: int = RRF_K, weight: float = RECENCY_WEIGHT, gap: float = GAP, fresh: bool = False) -> Envelope:
        """Both legs fused, or what there is of them; alpha 1 is semantic, 0 keyword search."""
        if not query.strip():
            raise ValueError("an empty query")
        limit, offset = max(1, min(limit, MOST)), max(0, offset)
        asked = self.cache.key(state=self._state(), query=query, alpha=alpha, limit=limit, offset=offset, filters=filters, k=k, weight=weight, gap=gap)
        if not fresh and (held := self.cache.get(asked)):
            return held
        found, mode, alpha, warnings = self._search(query, alpha, max(retrieval.CANDIDATES, offset + limit), filters, k, weight, gap)
        out = Envelope(found, mode, alpha, warnings, limit, offset)
        self.cache.put(asked, out)
        return out

    def _vector(self, query: str, alpha: float, warnings: list[str]) -> list[float] | None:
        """The query's vector; None, with a warning, where there is none."""
        if alpha <= 0:
            return None
        try:
            vector = self.embed(query) if self.embed and self.vectors is not None else None
        except Exception as error:
            warnings.append(f"embedding failed: {error}")
            vector = None
        if vector is None:
            warnings.append("no vectors: keywords only")
        return vector

    def _leg(self, warnings: list[str]) -> Callable | None:
        """How the keyword leg is searched: stored words, all texts (None), or terms where words can't be searched."""
        if self.words is not None:
            return lambda rows, query, k: self.words.top_k(query, k, rows)
        if self.searchable:
            return None
        warnings.append("no word index: terms stand in for it")
        source = self.queue if self.queue is not None else self.chunks
        return lambda rows, query, k: retrieval.like_top_k(source.join(rows.select("chunk_id"), "chunk_id", "left_semi"), query, k)

    def _search(self, query, alpha, candidates, filters, k, weight, gap) -> tuple[DataFrame, str, float, list[str]]:
        warnings: list[str] = []
        if self.chunks is None:
            if self.queue is None:
                raise ValueError("neither an index nor a queue")
            found = retrieval.like_score(retrieval.scoped(self.queue, filters), query).withColumn("score", F.col("score").cast("double"))
            best = retrieval.gap_cut(found.orderBy(F.desc("score"), "chunk_id").limit(candidates), gap)
            return best, "terms_only", 0.0, ["no index: the queue was searched by terms"]
        if retrieval.scoped(self.chunks, filters).isEmpty():
            other = filters.version is not None and not retrieval.scoped(self.chunks, replace(filters, version=None)).isEmpty()
            if other:
                warnings.append("schema version mismatch: only rows of other versions fit")
            none = self.chunks.select(F.lit(0).cast("long").alias("rank"), "chunk_id", "file_path", F.lit(0.0).alias("score")).limit(0)
            return none, "keyword_only" if other else "hybrid", alpha, warnings
        vector = self._vector(query, alpha, warnings)
        if vector is None:
            alpha = 0.0
        vectors = self.vectors if vector is not None else self.chunks.select("chunk_id", F.array().cast("array<float>").alias("vector")).limit(0)
        if candidates > retrieval.DEEP:
            found = retrieval.deep_hybrid(self.chunks, vectors, query, vector or [0.0], filters, self.now_ns(), candidates, alpha, k, weight, gap, self._leg(warnings))
        else:
            found = retrieval.hybrid(self.chunks, vectors, query, vector or [0.0], filters, self.now_ns(), alpha, k, weight, gap, candidates, self._leg(warnings))
        return found, mode_of(alpha, vector is not None, True), alpha, warnings

    def semantic(self, query: str, **options) -> Envelope:
        return self.search(query, alpha=1.0, **options)

    def keyword(self, query: str, **options) -> Envelope:
        return self.search(query, alpha=0.0, **options)

    def context_pack(self, query: str, max_files: int = 8, max_chars: int = 12_000, neighbors: bool = True, hops: int = 1, keep: str = "middle", judge: Callable[[str, list[str]], str] | None = None, **options) -> DataFrame:
        """Excerpts around the best hits; a judge, given the texts, may say in which order they go."""
        hits = self.search(query, limit=MOST, **options).rows
        if judge:
            top = hits.filter(F.col("rank") <= context.RERANKED).join(self.chunks.select("chunk_id", F.substring("text", 1, 400).alias("text")), "chunk_id").orderBy("rank").collect()
            order = context.parse_order(judge(query, [r["text"] for r in top]), len(top))
            hits = context.rerank(hits, order).drop("rank").withColumnRenamed("reranked", "rank")
        return context.pack(self.chunks, hits.select("chunk_id", "file_path", "rank"), max_files, max_chars, hops if neighbors else 0, keep)

    def neighbors(self, chunk_id: str, before: int = 2, after: int = 2) -> DataFrame:
        target = self.chunks.filter(F.col("chunk_id") == chunk_id).select("chunk_id")
        return context.neighbors(self.chunks, target, before, after)

    def get(self, chunk_id: str, fields: list[str] | None = None, max_chars: int = 0) -> DataFrame:
        rows = self.chunks if self.chunks is not None else self.queue
        return context.view(rows.filter(F.col("chunk_id") == chunk_id), fields or rows.columns, max_chars)

    def file_chunks(self, file_path: str, function_name: str | None = None, limit: int = 200) -> DataFrame:
        """The chunks of a file, by its whole path or its end, in reading order."""
        rows = self.chunks if self.chunks is not None else self.queue
        rows = rows.filter((F.col("file_path") == file_path) | F.col("file_path").endswith(f"/{file_path}"))
        if function_name is not None:
            rows = rows.filter(F.col("function_name") == function_name)
        return rows.orderBy("file_path", "start_line", "chunk_id").limit(limit)

    def similar(self, chunk_id: str | None = None, limit: int = 10, file_path: str | None = None, function_name: str | None = None) -> DataFrame:
        """The chunks nearest to one: that of the id, or the first of a file, or of a function (in a file or anywhere)."""
        if chunk_id is None:
            if file_path is None and function_name is None:
                raise ValueError("a chunk, a file or a function is needed")
            rows = self.chunks
            if file_path is not None:
                rows = rows.filter((F.col("file_path") == file_path) | F.col("file_path").endswith(f"/{file_path}"))
            if function_name is not None:
                rows = rows.filter(F.col("function_name") == function_name)
            order = ["file_path", *(c for c in ("start_line",) if c in rows.columns), "chunk_id"]
            seed = rows.join(self.vectors.select("chunk_id"), "chunk_id", "left_semi").orderBy(*order).select("chunk_id").first()
            chunk_id = seed["chunk_id"] if seed else ""
        return retrieval.similar(self.chunks, self.vectors, chunk_id, limit)

    def explain(self, query: str, chunk_id: str, alpha: float = ALPHA) -> DataFrame:
        """Rank and parts of one chunk's score; no row if it isn't a candidate. Without vectors, of the keyword leg alone."""
        found, _, _, _ = self._search(query, alpha, retrieval.CANDIDATES, Filters(), RRF_K, RECENCY_WEIGHT, 0.0)
        return found.filter(F.col("chunk_id") == chunk_id)

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, name, depth)

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callees(self.nodes, self.edges, name, depth)

    def imports(self, file_path: str | None = None) -> DataFrame:
        return graph.imports(self.nodes, self.edges, file_path)

    def path(self, source: str, target: str) -> DataFrame:
        return graph.trace_path(self.nodes, self.edges, source, target)
