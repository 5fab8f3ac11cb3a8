"""Product quantisation inside the cells of a vector index: a search reads a byte for each part of a vector, not the vector.

A row's code are the nearest entries, part by part, to what is left of its unit
vector when its cell's centre is taken away.  The dot product of a query with a row
is then about that with the centre plus one table entry for each part: the tables
are made once a query, whatever the cell.  Tasks add these up for Arrow batches of
codes and keep the best; of the best of all tasks the whole vectors are read and
ranked by their exact distance.

What is broadcast or collected has constant bounds: the centres, ``ENTRIES`` entries for
each part, ``BLOCK`` queries at a time, and the candidates that are ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from lodestone.operators import ivf
from lodestone.operators.folder import Commits, Folder
from lodestone.operators.retrieval import _dot
from lodestone.operators.scratch import gathered, written

ENTRIES, ROUNDS, BLOCK = 256, 12, 64
# Parts of a vector, the first that divides it (of so many, or of this share of its length); vectors new after which an index is built again.
PARTS, SHARES, REBUILD = 96, (16, 8), 5000


def parts_of(dimension: int) -> int:
    """How many parts a vector is cut into."""
    return next(m for m in (PARTS, *(dimension // s for s in SHARES), 1) if m and dimension % m == 0)


@dataclass(frozen=True)
class Quantiser:
    """Centres of the cells (cell, component) and entries of the codebooks (part, entry, component)."""

    centres: np.ndarray
    books: np.ndarray

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dot products of unit queries with centres (query, cell) and entries (query, part, entry)."""
        m, _, width = self.books.shape
        return queries @ self.centres.T, np.einsum("qmw,mew->qme", queries.reshape(len(queries), m, width), self.books)


def _units(column: pa.Array, dimension: int) -> np.ndarray:
    rows = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension))
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1.0)


def _codebook(x: np.ndarray) -> np.ndarray:
    """Lloyd's rounds from rows spread over x."""
    books = x[np.linspace(0, len(x) - 1, min(ENTRIES, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = ((books * books).sum(1) - 2 * x @ books.T).argmin(1)
        n = np.bincount(near, minlength=len(books))
        total = np.stack([np.bincount(near, x[:, k], len(books)) for k in range(x.shape[1])], 1)
        books[n > 0] = total[n > 0] / n[n > 0, None]
    return books


def train(placed: DataFrame, centres: np.ndarray) -> Quantiser:
    """Codebooks of all parts, each in a task of its own, from at most ``ivf.SAMPLE`` rows (chunk_id, vector, cell), in the order of a hash."""
    dimension = centres.shape[1]
    m, shared = parts_of(dimension), placed.sparkSession.sparkContext.broadcast(centres)
    total = placed.count()
    share = min(1.0, 1.5 * ivf.SAMPLE / max(total, 1))
    near = placed.filter((F.col("cell") >= 0) & (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = near.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(ivf.SAMPLE).select("cell", "vector")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = (_units(batch["vector"], dimension) - shared.value[batch["cell"].to_numpy()]).reshape(len(batch), m, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(m, dtype=np.int32), len(batch))), pa.array([x.tobytes() for x in left.reshape(len(batch) * m, -1)], pa.binary())], names=["part", "x"])

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack([np.frombuffer(r) for r in sorted(rows["x"])])
        return pd.DataFrame({"part": rows["part"].iloc[0], "book": [_codebook(x).tobytes()]})

    made = written(sample.mapInArrow(cut, "part int, x binary"), "parts").groupBy("part").applyInPandas(fit, "part int, book binary").collect()
    books = [np.frombuffer(r["book"]).reshape(-1, dimension // m) for r in sorted(made)]
    return Quantiser(centres, np.stack(books) if books else np.zeros((m, 1, dimension // m)))


def encoded(placed: DataFrame, quantiser: Quantiser) -> DataFrame:
    """The rows (vector, cell) with their ``code``, a byte a part; null for rows in no cell."""
    shared = placed.sparkSession.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        dimension, (m, _, width) = q.centres.shape[1], q.books.shape
        own = (q.books * q.books).sum(2)
        for batch in batches:
            cell = batch["cell"].to_numpy()
            fit = np.flatnonzero(cell >= 0)
            left = (_units(batch["vector"].take(pa.array(fit)), dimension) - q.centres[cell[fit]]).reshape(-1, m, width)
            code = np.stack([(own[p] - 2 * left[:, p] @ q.books[p].T).argmin(1) for p in range(m)], 1).astype(np.uint8)
            out = np.full(len(batch), None, object)
            out[fit] = [x.tobytes() for x in code]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "code"])

    return placed.mapInArrow(run, StructType([*placed.schema.fields, StructField("code", BinaryType())]))


def candidates(indexed: DataFrame, quantiser: Quantiser, queries: list[list[float]], n: int, probes: int | None = None) -> DataFrame:
    """(q, chunk_id, cell): for each query, by its place, the n rows of the ``probes`` nearest cells (all: None) with the greatest estimated dot products.

    Codes and cells are read, no vectors.
    """
    x = np.nan_to_num(np.array(queries, float))
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    x = x / np.where(norm > 0, norm, 1.0)
    centre, entry = quantiser.tables(x)
    order = np.argsort(((quantiser.centres**2).sum(1) - 2 * centre), axis=1, kind="stable")[:, :probes]
    asked = np.zeros(centre.shape, bool)
    np.put_along_axis(asked, order, True, 1)
    shared = indexed.sparkSession.sparkContext.broadcast((np.where(asked, centre, -np.inf), entry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, entry = shared.value
        m = entry.shape[1]
        best: list[tuple] = [(np.empty(0), np.empty(0, object), np.empty(0, np.int32)) for _ in centre]
        for batch in batches:
            code = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, m)
            cell, ids = batch["cell"].to_numpy(), np.array(batch["chunk_id"].to_pylist(), object)
            for q in range(len(centre)):
                score = centre[q, cell] + entry[q, np.arange(m), code].sum(1)
                score, names, cells = np.append(best[q][0], score), np.append(best[q][1], ids), np.append(best[q][2], cell)
                keep = np.flatnonzero(score > -np.inf)
                if len(keep) > n:
                    keep = keep[np.argpartition(-score[keep], n - 1)[:n]]
                best[q] = score[keep], names[keep], cells[keep]
        place = np.repeat(np.arange(len(best), dtype=np.int32), [len(b[0]) for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate([b[1] for b in best]).tolist(), pa.string()), pa.array(np.concatenate([b[2] for b in best]).astype(np.int32)), pa.array(np.concatenate([b[0] for b in best]))], names=["q", "chunk_id", "cell", "score"])

    opened = indexed.filter(F.col("cell").isin(*map(int, np.flatnonzero(asked.any(0)))) & F.col("code").isNotNull())
    found = opened.select("chunk_id", "cell", "code").mapInArrow(run, "q int, chunk_id string, cell int, score double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "chunk_id"))
    return found.withColumn("_r", rank).filter(F.col("_r") <= n).select("q", "chunk_id", "cell")


def top_k(indexed: DataFrame, quantiser: Quantiser, queries: list[list[float]], k: int, refine: int = 20, probes: int | None = None) -> DataFrame:
    """(q, rank, chunk_id, distance): for each query its k nearest of k * refine candidates, by exact cosine distance.

    The answers of more than one block are written, so that no task holds the sorts of all.
    """
    spark = indexed.sparkSession

    def answers(i: int) -> DataFrame:
        block = queries[i : i + BLOCK]
        found = written(candidates(indexed, quantiser, block, k * refine, probes), "candidates")
        asked = spark.createDataFrame([(q, [float(v) for v in x]) for q, x in enumerate(block)], "q int, _x array<double>")
        rows = indexed.join(F.broadcast(found), ["chunk_id", "cell"]).join(F.broadcast(asked), "q")  # BLOCK * k * refine rows at most
        norms = F.sqrt(_dot(F.col("vector"), F.col("vector"))) * F.sqrt(_dot(F.col("_x"), F.col("_x")))
        near = rows.select((F.col("q") + i).alias("q"), "chunk_id", F.round(1 - _dot(F.col("vector"), F.col("_x")) / F.nullif(norms, F.lit(0.0)), 6).alias("distance")).filter("distance is not null")
        rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "chunk_id"))
        return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("q", "rank", "chunk_id", "distance")

    blocks = range(0, len(queries), BLOCK)
    return answers(0) if len(blocks) == 1 else gathered(map(answers, blocks), "nearest")


class VectorIndex:
    """A stored index of (chunk_id, vector): cells with codes, in segments under one quantiser.

    ``refresh`` takes in what is new and forgets what is gone.  New rows go to a segment
    of their own; once ``REBUILD`` of them came since the last build, or as many as were
    built, all is built again, centres and codebooks included.
    """

    def __init__(self, spark: SparkSession, path: str, guard=None):
        self.spark, self.path, self.folder = spark, path.rstrip("/"), Folder(spark, path)
        self.commits = Commits(self.folder, guard)

    def _model(self, n: int) -> Quantiser:
        row = self.spark.read.parquet(f"{self.path}/model={n}").first()
        dimension, m = row["dimension"], row["parts"]
        return Quantiser(np.frombuffer(row["centres"]).reshape(-1, dimension), np.frombuffer(row["books"]).reshape(m, -1, dimension // m))

    def _segment(self, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segment={n}")

    def rows(self) -> DataFrame | None:
        """All rows indexed: chunk_id, vector, cell, cell_distance, code."""
        state = self.commits.last()[1]
        out = None
        for n in state.get("segments", []):
            out = self._segment(n) if out is None else out.unionByName(self._segment(n))
        if out is not None and state["gone"]:
            gone = self.spark.read.parquet(*(f"{self.path}/gone={n}" for n in state["gone"]))
            out = out.join(gone.select("chunk_id").distinct(), "chunk_id", "left_anti")
        return out

    def _write(self, rows: DataFrame, n: int) -> None:
        rows.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/segment={n}")

    def build(self, vectors: DataFrame) -> int:
        """The index of these rows, anew; the number of rows."""
        before, _ = self.commits.last()
        n = before + 1
        placed, centres = ivf.build(vectors.select("chunk_id", "vector"))
        placed = written(placed, "placed")
        quantiser = train(placed, np.array(centres))
        self._write(encoded(placed, quantiser), n)
        model = [(int(quantiser.centres.shape[1]), int(quantiser.books.shape[0]), bytearray(quantiser.centres.tobytes()), bytearray(quantiser.books.tobytes()))]
        self.spark.createDataFrame(model, "dimension int, parts int, centres binary, books binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model={n}")
        total = placed.count()
        self.commits.add(before, {"model": n, "segments": [n], "gone": [], "built": total, "since": 0})
        return total

    def refresh(self, vectors: DataFrame) -> str:
        """Brings the index to the rows of vectors, whose ids name their contents: 'built', 'added' or 'same'."""
        before, state = self.commits.last()
        if not state:
            self.build(vectors)
            return "built"
        have = self.rows().select("chunk_id")
        new = written(vectors.select("chunk_id", "vector").join(have, "chunk_id", "left_anti"), "new")
        gone = written(have.join(vectors.select("chunk_id"), "chunk_id", "left_anti"), "gone")
        added, lost = new.count(), gone.count()
        since = state["since"] + added
        if since >= min(REBUILD, max(1, state["built"])):
            self.build(vectors)
            return "built"
        if not added and not lost:
            return "same"
        n, segments, forgotten = before + 1, state["segments"], state["gone"]
        back = bool(added and forgotten) and not new.join(self.spark.read.parquet(*(f"{self.path}/gone={x}" for x in forgotten)), "chunk_id", "left_semi").isEmpty()
        if back:  # an id that came again would be hidden by its earlier end
            self.build(vectors)
            return "built"
        if added:
            quantiser = self._model(state["model"])
            self._write(encoded(ivf.placed(new, quantiser.centres), quantiser), n)
            segments = [*segments, n]
        if lost:
            gone.write.mode("overwrite").parquet(f"{self.path}/gone={n}")
            forgotten = [*forgotten, n]
        self.commits.add(before, {"model": state["model"], "segments": segments, "gone": forgotten, "built": state["built"], "since": since})
        return "added"

    def top_k(self, queries: list[list[float]], k: int, refine: int = 20, probes: int | None = None) -> DataFrame:
        return top_k(self.rows(), self._model(self.commits.last()[1]["model"]), queries, k, refine, probes)

    def exact(self, query: list[float], k: int) -> DataFrame:
        """The k nearest rows of all, by the cells' bounds."""
        return ivf.top_k(self.rows(), self._model(self.commits.last()[1]["model"]).centres.tolist(), query, k)
