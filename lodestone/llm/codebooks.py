"""Vector code compression: product codebooks of integers, refined in rounds over all vectors.

Each component x becomes floor(256 * x), and a vector is cut into ``PARTS`` equal
parts.  The codebook of a part starts as that part of the vectors with the least
ids.  A round broadcasts the codebooks (``ENTRIES`` times a vector's length: the
bound doesn't depend on the rows), assigns every part of every vector to the
nearest entry, and moves each entry to the floored mean of its parts.

Arrow batches compute the distances to all entries at once by the norm expansion
|x|^2 - 2 x.c + |c|^2 with int64 matrix products, which are exact; argmin takes the
first of equal distances.  A task keeps the sums and counts of each entry and
emits them once, and a grouped shuffle merges them: the rows that are shuffled are
entries by tasks, whatever the vectors.  A label in a third of all rows is one
group of sums that combine before the shuffle, joined back by a join that adaptive
execution can split.

Edge cases: vectors that are null or hold a null or non-finite component are
dropped.  The dimension is the length of the least id's vector that isn't empty;
it must be a multiple of ``PARTS``, else an error says so.  Kept vectors of another
length stay, with code and error null.  Rows with one id are coded each for
itself; as a seed such an id counts once, with its least vector; null ids are no
seeds.  Fewer ids than entries make smaller codebooks; without any id or row there
are none, and codes are null.  Components so large that a squared distance would
pass 62 bits are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from lodestone.llm.tables import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that one numpy step takes.
STEP = 2048


def kept(vectors: DataFrame) -> DataFrame:
    """The rows whose vector isn't null and holds finite numbers only."""
    return vectors.filter("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")


def seeds(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> np.ndarray:
    """(part, entry, position): the first codebooks, of the least ids; empty without rows."""
    whole = vectors.filter("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))
    first = whole.select("vec_id", F.size("v").alias("n")).groupBy("vec_id").agg(F.min("n").alias("n")).orderBy("vec_id").limit(1).collect()
    if not first:
        return np.empty((parts, 0, 1), np.int64)
    dimension = first[0]["n"]
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} equal parts")
    same = whole.filter(F.size("v") == dimension)
    ids = same.select("vec_id").distinct().orderBy("vec_id").limit(entries)
    rows = same.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors have the dimension, and the integer components of those."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    fits = sizes == dimension
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    values = values[np.repeat(fits, sizes)]
    return fits, _bounded(values, dimension).astype(np.int64).reshape(-1, dimension)


def _bounded(values: np.ndarray, dimension: int) -> np.ndarray:
    most = float(np.abs(values).max(initial=0.0))
    if dimension * (2 * most + 1) ** 2 >= 2.0**62:
        raise ValueError(f"a component of {most / SCALE} is too large for exact distances")
    return values


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, for each vector (rows of x: vector, part, position) and part."""
    across = np.matmul(x.transpose(1, 0, 2), books.transpose(0, 2, 1))
    distance = (x * x).sum(2).T[:, :, None] - 2 * across + (books * books).sum(2)[:, None, :]
    code = distance.argmin(2)
    return code.T, np.take_along_axis(distance, code[:, :, None], 2)[:, :, 0].T


def _steps(column: pa.Array, books: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, which fit, vectors by part) of each step of a batch."""
    parts, _, width = books.shape
    for i in range(0, len(column), STEP):
        j = min(i + STEP, len(column))
        fits, x = integers(column.slice(i, j - i), parts * width)
        yield i, j, fits, x.reshape(-1, parts, width)


def moved(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry at the floored mean of the parts assigned to it."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        parts, entries, width = books.shape
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for _, _, _, x in _steps(batch["embedding"], books):
                at = nearest(x, books)[0] + np.arange(parts) * entries
                np.add.at(total, at.ravel(), x.reshape(-1, width))
                count += np.bincount(at.ravel(), minlength=parts * entries)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width), pa.int32()), pa.array(np.tile(np.arange(width), len(used)), pa.int32()), pa.array(total[used].ravel()), pa.array(np.repeat(count[used], width))],
            names=["entry", "position", "total", "n"],
        )

    sums = vectors.select("embedding").mapInArrow(run, "entry int, position int, total long, n long").groupBy("entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    parts, entries, width = books.shape
    out = books.reshape(parts * entries, width).copy()
    for r in sums.collect():
        out[r["entry"], r["position"]] = r["total"] // r["n"]
    return out.reshape(books.shape)


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    rows = vectors.select("vec_id", "label", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            for i, j, fits, x in _steps(batch["embedding"], books):
                codes, errors = np.full(j - i, None, object), np.zeros(j - i, np.int64)
                if books.shape[1]:
                    index, distance = nearest(x, books)
                    digits = index.astype(np.uint8).tobytes().hex()
                    step = 2 * books.shape[0]
                    codes[fits] = [digits[a : a + step] for a in range(0, len(digits), step)]
                    errors[fits] = distance.sum(1)
                else:
                    fits = np.zeros(j - i, bool)
                yield pa.RecordBatch.from_arrays([batch["vec_id"].slice(i, j - i), batch["label"].slice(i, j - i), pa.array(codes, pa.string()), pa.array(errors, pa.int64(), mask=~fits)], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def fit(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> np.ndarray:
    """(part, entry, position) of the codebooks after all rounds; at most 256 entries, as a code takes two hex digits."""
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    books = seeds(vectors, entries, parts)
    for _ in range(rounds if books.shape[1] else 0):
        books = moved(vectors, books)
    return books


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """The rows of codes (any columns, ``code``) with ``approximate``, the vector that the code stands for; null for a null code."""
    shared = codes.sparkSession.sparkContext.broadcast(books)
    at = codes.columns.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            rows = [None if c is None else (books[np.arange(books.shape[0]), list(bytes.fromhex(c))].ravel() / SCALE).tolist() for c in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names, "approximate"])

    return codes.mapInArrow(run, StructType([*codes.schema.fields, StructField("approximate", ArrayType(DoubleType()))]))


def report(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error and the digest of the codebooks."""
    rows = kept(vectors.select("vec_id", "label", "embedding"))
    books = fit(rows)
    done = materialize(coded(rows, books), "codes")
    sums = materialize(done.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "label_errors")
    return done.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
, near{k} AS MATERIALIZED (
  SELECT r, p, min(dist * {ENTRIES} + e) AS best
  FROM (SELECT parts.r, parts.p, c.e, list_sum(list_transform(list_zip(parts.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM parts JOIN books{k} c USING (p))
  GROUP BY r, p
)"""


def _move_sql(k: int) -> str:
    return f"""
, sums{k} AS (
  SELECT p, CAST(best % {ENTRIES} AS INTEGER) AS e, i, CAST(floor(CAST(sum(v) AS DOUBLE) / count(*)) AS BIGINT) AS v
  FROM (SELECT near{k}.p, best, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM near{k} JOIN parts USING (r, p)) GROUP BY p, e, i
), means{k} AS (
  SELECT p, e, list(v ORDER BY i) AS x FROM sums{k} GROUP BY p, e
), books{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(means{k}.x, books{k}.x) AS x FROM books{k} LEFT JOIN means{k} USING (p, e)
)"""


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, CAST(p AS INTEGER) AS p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)
), firsts AS (
  SELECT vec_id, min(v) AS v FROM kept WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {ENTRIES}
), numbered AS (
  SELECT v, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS e FROM firsts
), books0 AS MATERIALIZED (
  SELECT CAST(p AS INTEGER) AS p, e, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM numbered, range({PARTS}) t(p)
){"".join(_round_sql(k) + _move_sql(k) for k in range(ROUNDS))}{_round_sql(ROUNDS)}
, coded AS (
  SELECT r, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r
), flat AS (
  SELECT p, e, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM books{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM flat) AS codebooks_sha256
FROM kept JOIN coded USING (r)
"""
