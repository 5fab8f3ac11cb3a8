"""A stored word index in segments: a batch of changes is a segment of its own and a list of what it makes dead.

A posting carries its chunk's number of words, so a search reads the postings of its
words alone, no table of all lengths; the number of chunks and words is kept with
each commit.  Postings of a term lie in blocks by ranges of chunks: chunks of like
length share a range, and a block says how often the term stands in one of them at
most and how short the shortest is.  That bounds the score of every chunk of a range
from above, so a top-k scores the best ranges first and then only those that can
reach the k-th score.

Segments are merged when there are ``SEGMENTS`` of them: the smaller ones, or all where
these outweigh the largest, so each posting is written a few times however many
batches come.  Scores are those of ``retrieval.bm25`` over all chunks of the index.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.functions import text as t
from lodestone.operators.batches import bound
from lodestone.operators.folder import Commits, Folder
from lodestone.operators.retrieval import K1, B

SEGMENTS = 8
#: Postings that a folder of a segment holds about, folders of a segment at most, and chunks of a range.
FOLDER_POSTINGS, FOLDERS, RANGE = 2_000_000, 1024, 128
#: Postings that a task of a write sorts about, and bytes of a text that are cut into words at a time.
TASK_POSTINGS, PIECE = 500_000, 1 << 20
#: Ranges that a top-k scores first.
FIRST = 32


#: What stands between words becomes a blank: every byte but those of ``[a-z0-9_.]``, so all of a character beyond ASCII.
_WORDS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789_." else 32 for b in range(256))
_BLOCK = "bucket int, term string, range long, size int, most long, least long, ids array<string>, tfs array<long>, ns array<long>"


def _occurrences(text: bytes) -> Counter:
    """How often each word stands in a lower-cased text; the words are those of ``text.tokens``."""
    words, found, start = text.translate(_WORDS), Counter(), 0
    while start < len(words):
        end = words.find(b" ", start + PIECE)
        end = len(words) if end < 0 else end
        found.update(words[start:end].split())
        start = end
    return found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, n, p) of (chunk_id, lower-cased text): the number of words, and each word with its number."""
    for batch in batches:
        terms, tfs, ends, ns = [], [], [0], []
        for text in batch.column(1).cast(pa.binary()).to_pylist():
            found = _occurrences(text)
            terms.extend(found)
            tfs.extend(found.values())
            ends.append(len(terms))
            ns.append(found.total())
        pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(tfs, pa.int64())], ["term", "tf"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["chunk_id", "n", "p"])


def _block(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """A block of each run of rows."""
    ends = np.append(starts, len(rows))
    tf, n = rows["tf"].to_numpy(), rows["n"].to_numpy()
    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows[c]) for c in ("chunk_id", "tf", "n")]
    keys = [rows[c].take(pa.array(starts)) for c in ("bucket", "term", "range")]
    numbers = [pa.array(np.diff(ends), pa.int32()), pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(n, starts))]
    return pa.RecordBatch.from_arrays([*keys, *numbers, *lists], names=["bucket", "term", "range", "size", "most", "least", "ids", "tfs", "ns"])


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that come in the order of term and range; the last run of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        new = [pc.not_equal(batch[c].slice(1), batch[c].slice(0, len(batch) - 1)) for c in ("term", "range")]
        starts = np.append(0, 1 + np.flatnonzero(pc.or_(*new).to_numpy(zero_copy_only=False)))
        rest = batch.slice(starts[-1])
        if len(starts) > 1:
            yield _block(batch.slice(0, starts[-1]), starts[:-1])
    if rest is not None:
        yield _block(rest, np.array([0]))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _part(idf: Column, tf: Column, n: Column, mean: float) -> Column:
    """A term's part of a score; it grows with tf and falls with n."""
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + F.lit(K1) * (1 - B + B * n / F.lit(mean or 1.0)))


class WordIndex:
    """The index in the folder ``path``; ``guard`` is asked before each commit."""

    def __init__(self, spark: SparkSession, path: str, guard: Callable[[], None] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, path)
        self.commits = Commits(self.folder, guard)

    # --- what is stored ---

    def _dead(self, state: dict) -> DataFrame | None:
        """(chunk_id, segment) of postings that no longer count."""
        return self.spark.read.parquet(*(f"{self.path}/dead={n}" for n in state["dead"])).select("chunk_id", "segment") if state["dead"] else None

    def _docs(self, state: dict) -> DataFrame:
        """(chunk_id, n, segment) of the chunks that count."""
        rows = _union([self.spark.read.parquet(f"{self.path}/segment={s['id']}/docs").withColumn("segment", F.lit(s["id"])) for s in state["segments"]])
        dead = self._dead(state)
        return rows.join(dead, ["chunk_id", "segment"], "left_anti") if dead is not None else rows

    def _postings(self, segment: dict) -> DataFrame:
        """All blocks of a segment; one without words has no file that would tell their columns."""
        if not segment["words"]:
            return self.spark.createDataFrame([], _BLOCK)
        return self.spark.read.parquet(f"{self.path}/segment={segment['id']}/postings")

    def _blocks(self, state: dict, words: list[str]) -> DataFrame:
        """Blocks of the words: segment, term, range, size, most, least, and the postings ids, tfs, ns."""
        parts = []
        for s in state["segments"]:
            rows = self._postings(s)
            buckets = sorted({zlib.crc32(w.encode()) % s["folders"] for w in words})
            parts.append(rows.filter(F.col("bucket").isin(*buckets) & F.col("term").isin(*words)).drop("bucket").withColumn("segment", F.lit(s["id"])))
        return _union(parts)

    def _count(self, put: DataFrame, path: str) -> DataFrame:
        """(chunk_id, n, p) of chunks (chunk_id, text), written: the number of words, and each word with its number."""
        bound(self.spark)
        rows = put.select("chunk_id", F.lower(F.coalesce("text", F.lit(""))).alias("text"))
        schema = StructType([rows.schema["chunk_id"], *StructType.fromDDL("n long, p array<struct<term: string, tf: long>>").fields])
        rows.mapInArrow(_counted, schema).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _write(self, docs: DataFrame, postings: DataFrame, n: int) -> dict:
        """A segment of docs (chunk_id, n) and postings (chunk_id, term, tf, n); its entry in the state.

        Postings are shuffled once, to tasks that hold a share of the ranges of one folder, and sorted there.
        """
        docs.write.mode("overwrite").parquet(f"{self.path}/segment={n}/docs")
        stored = self.spark.read.parquet(f"{self.path}/segment={n}/docs")
        chunks, total = stored.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        folders = max(1, min(FOLDERS, -(-total // FOLDER_POSTINGS)))
        # chunks of like length, in shares of a hash that hold RANGE of them on average if lengths spread over some ten classes
        share = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, chunks // (10 * RANGE))))
        place = F.floor(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double")) * 2) * F.lit(1 << 40) + share
        bucket = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(folders)).cast("int")
        slots = max(1, -(-total // (TASK_POSTINGS * folders)))
        rows = postings.select(bucket.alias("bucket"), "term", place.alias("range"), "chunk_id", "tf", "n")
        task = F.col("bucket") * slots + F.pmod(F.xxhash64("range"), F.lit(slots)).cast("int")
        bound(self.spark)
        cut = rows.repartitionById(folders * slots, task).sortWithinPartitions("term", "range", "chunk_id").mapInArrow(_blocked, _BLOCK)
        cut.sortWithinPartitions("bucket", "term", "range").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/segment={n}/postings")
        return {"id": n, "folders": folders, "chunks": chunks, "words": total}

    # --- changes ---

    def change(self, put: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Takes chunks in (chunk_id, text; ids distinct), over those of the same id, and forgets others (chunk_id); the commit's number.

        Texts are read once: the words of each are counted and written, and lengths and postings come from there.
        """
        before, state = self.commits.last()
        state = state or {"segments": [], "dead": [], "chunks": 0, "words": 0}
        n = before + 1
        out = {"segments": list(state["segments"]), "dead": list(state["dead"]), "chunks": state["chunks"], "words": state["words"]}
        if put is not None:
            rows = self._count(put, f"{self.path}/segment={n}/counted")
            made = self._write(rows.select("chunk_id", "n"), rows.select("chunk_id", "n", F.inline("p")), n)
            self.folder.delete(f"segment={n}/counted")
            out["segments"] += [made] if made["chunks"] else []
            out["chunks"] += made["chunks"]
            out["words"] += made["words"]
        if state["segments"]:
            ids = [x.select("chunk_id") for x in (self.spark.read.parquet(f"{self.path}/segment={n}/docs") if put is not None else None, gone) if x is not None]
            if ids:
                dead = self._docs(state).join(_union(ids).distinct(), "chunk_id", "left_semi")
                dead.write.mode("overwrite").parquet(f"{self.path}/dead={n}")
                lost, words = self.spark.read.parquet(f"{self.path}/dead={n}").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
                if lost:
                    out["dead"].append(n)
                    out["chunks"] -= lost
                    out["words"] -= words
        if len(out["segments"]) > SEGMENTS:
            out = self._merged(out, n)
        return self.commits.add(before, out)

    def _merged(self, state: dict, n: int) -> dict:
        """The state with its smaller segments as one, or with all as one where these outweigh the largest."""
        largest = max(state["segments"], key=lambda s: s["words"])
        rest = [s for s in state["segments"] if s is not largest]
        if 2 * sum(s["words"] for s in rest) > largest["words"]:
            rest = state["segments"]
        part = {"segments": rest, "dead": state["dead"]}
        dead = self._dead(state)
        docs = self._docs(part)
        rows = _union([self._postings(s).withColumn("segment", F.lit(s["id"])) for s in rest])
        postings = rows.select("segment", "term", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("x")).select("segment", F.col("x.ids").alias("chunk_id"), "term", F.col("x.tfs").alias("tf"), F.col("x.ns").alias("n"))
        if dead is not None:
            postings = postings.join(dead, ["chunk_id", "segment"], "left_anti")
        made = self._write(docs.select("chunk_id", "n"), postings.drop("segment"), n * 1_000_000)
        left = [s for s in state["segments"] if s not in rest]
        return state | {"segments": [*left, made], "dead": state["dead"] if left else []}

    def vacuum(self) -> None:
        """Removes what the last commit doesn't read."""
        last, state = self.commits.last()
        used = {f"segment={s['id']}" for s in state.get("segments", [])} | {f"dead={x}" for x in state.get("dead", [])}
        for name in self.folder.names():
            number = name.partition("=")[2]
            if number and name not in used and int(number) // (1_000_000 if int(number) > last else 1) <= last:
                self.folder.delete(name)

    # --- searches ---

    def _live(self, state: dict, blocks: DataFrame) -> DataFrame:
        """(segment, range, term, chunk_id, tf, n) of the postings that count."""
        rows = blocks.select("segment", "range", "term", F.explode(F.arrays_zip("ids", "tfs", "ns")).alias("x")).select("segment", "range", "term", F.col("x.ids").alias("chunk_id"), F.col("x.tfs").alias("tf"), F.col("x.ns").alias("n"))
        dead = self._dead(state)
        return rows.join(dead, ["chunk_id", "segment"], "left_anti") if dead is not None else rows

    def _idf(self, state: dict, blocks: DataFrame, words: list[str]) -> Column:
        """Each term's weight; without dead chunks the blocks' sizes tell how many hold it."""
        rows = self._live(state, blocks).groupBy("term").agg(F.count("*").alias("df")) if state["dead"] else blocks.groupBy("term").agg(F.sum("size").alias("df"))
        df = {r["term"]: r["df"] for r in rows.collect()}
        out = F.lit(0.0)
        for w in words:
            out = F.when(F.col("term") == w, math.log(1 + (state["chunks"] - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))).otherwise(out)
        return out

    def bm25(self, words: list[str]) -> DataFrame:
        """(chunk_id, score) of all chunks that hold any of the words."""
        _, state = self.commits.last()
        if not words or not state.get("segments"):
            return self.spark.createDataFrame([], "chunk_id string, score double")
        blocks = self._blocks(state, words)
        return self._scored(self._live(state, blocks), self._idf(state, blocks, words), state)

    def _scored(self, live: DataFrame, idf: Column, state: dict) -> DataFrame:
        mean = state["words"] / state["chunks"] if state["chunks"] else 1.0
        return live.groupBy("chunk_id").agg(F.round(F.sum(_part(idf, F.col("tf"), F.col("n"), mean)), 6).alias("score"))

    def top_k(self, query: str, k: int, rows: DataFrame | None = None) -> DataFrame:
        """The k best chunks (chunk_id, score) by the query's words, of those in ``rows`` (chunk_id) if given.

        Ranges of chunks come by the bound of their score; once k chunks are found, ranges that can't reach the k-th are not scored.
        """
        words = t.keywords(query)
        _, state = self.commits.last()
        if not words or not state.get("segments"):
            return self.spark.createDataFrame([], "chunk_id string, score double")
        blocks = self._blocks(state, words)
        idf = self._idf(state, blocks, words)
        mean = state["words"] / state["chunks"] if state["chunks"] else 1.0
        order = lambda x: x.orderBy(F.desc("score"), "chunk_id").limit(k)
        only = lambda x: x.join(rows.select("chunk_id"), "chunk_id", "left_semi") if rows is not None else x
        bounds = blocks.groupBy("segment", "range").agg(F.sum(_part(idf, F.col("most"), F.col("least"), mean)).alias("bound"))
        first = F.broadcast(bounds.orderBy(F.desc("bound"), "segment", "range").limit(FIRST).select("segment", "range"))
        seen = order(self._scored(only(self._live(state, blocks.join(first, ["segment", "range"], "left_semi"))), idf, state)).agg(F.count("*"), F.min("score")).first()
        if seen[0] == k:
            blocks = blocks.join(bounds.filter(F.col("bound") >= seen[1] - 1e-5).select("segment", "range"), ["segment", "range"], "left_semi")
        return order(self._scored(only(self._live(state, blocks)), idf, state))

    def counts(self) -> tuple[int, int, int]:
        """Chunks, words and segments of the last commit."""
        state = self.commits.last()[1]
        return state.get("chunks", 0), state.get("words", 0), len(state.get("segments", []))


def write(chunks: DataFrame, path: str) -> WordIndex:
    """A new index of (chunk_id, text)."""
    index = WordIndex(chunks.sparkSession, path)
    index.change(chunks)
    return index
