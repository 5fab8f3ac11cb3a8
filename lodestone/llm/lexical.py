"""Ranked lexical search by branch and bound over hierarchical max trees.

The query items are taken in blocks of ``BLOCK_BYTES`` of text (one longer item is a
block), so what is broadcast has a constant bound however many items there are.
For each block:

1. One scan of the texts writes, per document, the block's terms it holds and how
   often, and per task the counts of documents, terms and documents by term.
2. Weights come from these counts, of all documents.
3. Tasks take the written rows in shards of ``SHARD`` postings or a batch more, documents by id, and
   build a tree over ranges of documents for each term: a leaf is a document and
   holds the term's part of its score, an inner node the greatest part in its range
   (``FAN`` children).  Only nodes that hold the term are stored.
4. Items are searched best first: of all open nodes the one with the highest sum of
   the item's maxima is opened next; nodes with equal bounds are opened in the order
   of their least id, as long as they can hold a document that ranks before the
   last of the best.  A task keeps its best documents from shard to shard.
5. The best of all tasks, at most ``K`` of each item from each, are ranked.

Texts are never shuffled; what is shuffled is the best of each task.  A term in
all documents costs each shard a tree of that term and no shuffle.

Edge cases: null or empty texts have no terms and are no documents of the counts;
null items or items without terms give no rows; each row of either table counts
for itself, also with a repeated or null id (null ids rank last among equal
scores); equal terms are terms with equal 64-bit hashes; an empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.llm import words as w
from lodestone.llm.tables import materialize

K = 20
#: Children of a node.
FAN_BITS = 5
FAN = 1 << FAN_BITS
#: A tree takes postings (some 40 bytes each) until there are so many; and bytes of items in a block.
SHARD, BLOCK_BYTES = 2_000_000, 4 << 20
#: A null id: as it stands in arrays, and above all ids where ranks are compared.
_NULL, _NO_ID = -(1 << 63), 1 << 63

Item = tuple[np.ndarray, np.ndarray]


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of the texts, and where each text's start."""
    data, offsets = w.text_bytes(pa.array(texts, pa.large_string()))
    starts, ends, first = w.words(data, offsets, w.ALNUM)
    return w.span_hash(data, starts, ends, fold=True), first


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, text) in blocks of bounded size; one partition at a time comes to the driver."""
    block, size = [], 0
    for row in items.filter("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        cost = 64 + len(row["text"].encode())
        if block and size + cost > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += cost
    if block:
        yield block


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Written rows of two kinds.

    Of documents that hold a term of the (sorted, hashed) vocabulary: doc_id, n (all their terms, with repeats), terms
    (places in the vocabulary) and how often each stands.  Of tasks (counts): n documents with ``total`` terms, and the
    number of documents by term.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(doc_ids, n, total, counts, offsets, terms, often):
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (terms.astype(np.int32), often.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array([counts] * len(n)), doc_ids, pa.array(n, pa.int64()), pa.array(total, pa.int64()), *lists], names=["counts", "doc_id", "n", "total", "terms", "often"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        documents = total = 0
        holding = np.zeros(len(known), np.int64)
        for batch in batches:
            data, offsets = w.text_bytes(batch["text"])
            for i, j in w.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends, first = w.words(part, at, w.ALNUM)
                n = np.diff(first)
                documents, total = documents + int((n > 0).sum()), total + len(starts)
                hashes = w.span_hash(part, starts, ends, fold=True)
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero(known[place] == hashes)
                doc = np.searchsorted(first, hit, "right") - 1
                key, often = np.unique(doc * len(known) + place[hit], return_counts=True)
                doc, term = key // len(known), key % len(known)
                holding += np.bincount(term, minlength=len(known))
                held = np.unique(doc)
                yield rows(batch["doc_id"].take(pa.array(held + i)), n[held], np.zeros(len(held), np.int64), False, np.append(np.searchsorted(doc, held), len(doc)), term, often)
        used = np.flatnonzero(holding)
        yield rows(pa.nulls(1, pa.int64()), [documents], [total], True, [0, len(used)], used, holding[used])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text IS NOT NULL").mapInArrow(run, "counts boolean, doc_id long, n long, total long, terms array<int>, often array<long>")
    return materialize(found, "postings")


def weights(rows: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, number of documents, number of their terms; from the tasks' counts."""
    counts = rows.filter("counts")
    n, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    out = np.zeros(terms, np.int64)
    holding = counts.select(F.explode(F.arrays_zip(F.col("terms").alias("t"), F.col("often").alias("n"))).alias("x")).groupBy("x.t").agg(F.sum("x.n").alias("n"))
    for r in holding.collect():  # as many as the block has terms, at most
        out[r["t"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["n"] + 1)))
    return out, n, total


class Tree:
    """For each term a max tree over the ranges of some documents, ordered by id.

    Level 0 has the documents; ``keys`` of a level are term * width + node in ascending order, ``most`` the maxima.
    """

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, part: np.ndarray):
        self.ids, self.levels = ids, []
        order = np.lexsort((doc, term))
        term, node, part, width = term[order].astype(np.int64), doc[order].astype(np.int64), part[order], len(ids)
        while True:
            self.levels.append((width, term * width + node, part))
            if width <= FAN:
                break
            node, width = node >> FAN_BITS, -(-width // FAN)
            key = term * width + node
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            term, node, part = term[first], node[first], np.maximum.reduceat(part, first)

    def sums(self, level: int, low: int, high: int, item: Item) -> np.ndarray:
        """The bounds, of documents the scores, of the nodes low to high of a level."""
        width, keys, most = self.levels[level]
        terms, repeats = item
        a, b = np.searchsorted(keys, terms * width + low), np.searchsorted(keys, terms * width + high)
        n = b - a
        at = np.arange(int(n.sum())) + np.repeat(a - np.cumsum(n) + n, n)
        out = np.zeros(high - low, np.int64)
        np.add.at(out, keys[at] - np.repeat(terms * width + low, n), most[at] * np.repeat(repeats, n))
        return out

    def search(self, item: Item, best: list[tuple[int, int]], k: int) -> int:
        """Puts the documents that rank among the k best into the heap ``best`` of (score, -id); gives the number of nodes opened."""
        top = len(self.levels) - 1
        opened, heap = 0, []
        node = (top, 0, self.levels[top][0])
        while True:
            level, low, high = node
            found = self.sums(level, low, high, item)
            opened += 1
            least = best[0][0] if len(best) == k else 1
            for at in np.flatnonzero(found >= max(least, 1)).tolist():
                bound, child = int(found[at]), low + at
                ident = int(self.ids[child << FAN_BITS * level])
                ident = _NO_ID if ident == _NULL else ident
                if level:
                    heapq.heappush(heap, (-bound, ident, level - 1, child))
                elif len(best) < k:
                    heapq.heappush(best, (bound, -ident))
                else:
                    heapq.heappushpop(best, (bound, -ident))
            if not heap:
                return opened
            bound, ident, level, parent = heapq.heappop(heap)
            if len(best) == k and (-bound, -ident) <= best[0]:
                return opened
            node = (level, parent << FAN_BITS, min(parent + 1 << FAN_BITS, self.levels[level][0]))


def _shard(batches: list[pa.RecordBatch], weight: np.ndarray, documents: int, total: int) -> Tree:
    table = pa.Table.from_batches(batches).combine_chunks()
    one = lambda name: table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
    ids = one("doc_id").fill_null(_NULL).to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, ids == _NULL))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    sizes = one("terms").value_lengths().to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(ids)), sizes)
    term, often = one("terms").flatten().to_numpy(zero_copy_only=False), one("often").flatten().to_numpy(zero_copy_only=False)
    longer = 100 - 25 + (25 * one("n").to_numpy(zero_copy_only=False) * documents) // total
    part = weight[term] * ((1_000_000_000 * often) // (1000 * often + 12 * longer[doc]))
    return Tree(ids[order], place[doc], term, part)


def best_of_tasks(rows: DataFrame, items: list[Item], found: tuple[np.ndarray, int, int], k: int = K) -> DataFrame:
    """(q, doc_id, score): of each task and item the k best of the task's documents; q is the item's place."""
    shared = rows.sparkSession.sparkContext.broadcast((items, found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, found = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held, size = [], 0

        def searched() -> None:
            tree = _shard(held, *found)
            for item, own in zip(items, best, strict=True):
                if len(item[0]):
                    tree.search(item, own, k)

        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch["terms"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
            for i, j in w.slices(ends, SHARD):
                held.append(batch.slice(i, j - i))
                size += int(ends[j] - ends[i])
                if size >= SHARD:
                    searched()
                    held, size = [], 0
        if held:
            searched()
        q = np.repeat(np.arange(len(items)), [len(x) for x in best])
        rows = [x for own in best for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array([None if x[1] == -_NO_ID else -x[1] for x in rows], pa.int64()), pa.array([x[0] for x in rows], pa.int64())], names=["q", "doc_id", "score"])

    return rows.filter("NOT counts").select("doc_id", "n", "terms", "often").mapInArrow(run, "q int, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """item_id, rank, doc_id and score of one block of items."""
    hashes, first = _terms([text for _, text in block])
    vocabulary, place = np.unique(hashes, return_inverse=True)
    asked = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        counts = sorted(Counter(place[a:b].tolist()).items())
        asked.append((np.array([t for t, _ in counts], np.int64), np.array([n for _, n in counts], np.int64)))
    names = docs.sparkSession.createDataFrame([(q, ident) for q, (ident, _) in enumerate(block)], StructType([StructField("q", IntegerType()), items.schema["item_id"]]))
    rows = postings(docs, vocabulary)
    best = best_of_tasks(rows, asked, weights(rows, len(vocabulary)), k)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """Per item the k documents with the highest scores above 0: item_id, rank, doc_id, score."""
    parts = [_block(docs, items, block, k) for block in _blocks(items) if len(_terms([text for _, text in block])[0])]
    if not parts:
        return items.sparkSession.createDataFrame([], StructType([items.schema["item_id"], StructField("rank", IntegerType()), StructField("doc_id", LongType()), StructField("score", LongType())]))
    return reduce(DataFrame.unionByName, parts)


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = f"""
WITH lists AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS ts FROM documents WHERE text IS NOT NULL
), totals AS (
  SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM lists WHERE len(ts) > 0
), items AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_FOLDED}, '{_TERM}') AS ts FROM benchmark WHERE text IS NOT NULL
), asked AS (
  SELECT q, item_id, t, count(*) AS repeats FROM (SELECT q, item_id, unnest(ts) AS t FROM items) GROUP BY ALL
), held AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM lists) WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM held, totals GROUP BY t, docs
), parts AS (
  SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part FROM held JOIN weight USING (t), totals
), scores AS (
  SELECT q, item_id, r, doc_id, CAST(sum(repeats * part) AS BIGINT) AS score FROM asked JOIN parts USING (t) GROUP BY ALL HAVING sum(repeats * part) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= {K}
"""
