"""A vector index: cells by k-means on a bounded sample, all rows in their cell.

A search first visits the cells nearest to the query.  The k-th distance found there
rules out each cell that lies farther away as a whole: by the triangle inequality no
row of a cell is nearer than its centre less the cell's radius.  All other cells are
visited too, so the result is exact; only a search with ``probes`` is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestone.operators.retrieval import vector_top_k
from lodestone.operators.scratch import written

#: Rows that cells are fitted on at most; cells at most (their number grows as the root of the rows').
SAMPLE, CELLS = 20_000, 2048
#: Cells that a search visits to bound the k-th distance.
FIRST = 8


def _unit(rows: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumn("_u", F.transform("vector", lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(1.0)))


def build(vectors: DataFrame, cells: int | None = None) -> tuple[DataFrame, list[list[float]]]:
    """(rows with their ``cell`` and ``cell_distance`` from its centre, centres): every row is in a cell, -1 if it has no vector of the common length.

    Centres come from a sample bounded by SAMPLE, in the order of a hash; rows are placed by a product of matrices a batch.
    """
    total = vectors.count()
    k = cells or min(CELLS, max(1, int(math.sqrt(total))))
    share = min(1.0, 1.5 * SAMPLE / max(total, 1))
    near = vectors.filter(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int(share * (1 << 20))))
    sample = written(_unit(near.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE)).select("_u").repartition(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "sample")
    model = KMeans(k=k, seed=7, maxIter=10).fit(sample.select(array_to_vector("_u").alias("features")))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    return placed(vectors, np.array(centres)), centres


def placed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows with the nearest cell of their vector and the distance from its centre, by a product of matrices a batch."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        own = (table * table).sum(axis=1)
        for batch in batches:
            column = batch["vector"]
            fit = np.flatnonzero(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1) == table.shape[1])
            rows = column.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, table.shape[1])
            rows = np.nan_to_num(rows)
            norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            rows = rows / np.where(norm > 0, norm, 1.0)
            apart = np.maximum((rows * rows).sum(axis=1)[:, None] - 2 * rows @ table.T + own, 0.0)
            cell, distance = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            cell[fit] = apart.argmin(axis=1)
            distance[fit] = np.sqrt(apart.min(axis=1, initial=np.inf))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names=[*batch.schema.names, "cell", "cell_distance"])

    schema = StructType([*vectors.schema.fields, StructField("cell", IntegerType()), StructField("cell_distance", DoubleType())])
    return vectors.mapInArrow(place, schema)


def write(vectors: DataFrame, name: str = "ivf") -> tuple[DataFrame, list[list[float]]]:
    """The index in the shared folder, a folder for each cell: a search opens those of the cells it visits."""
    rows, centres = build(vectors)
    return written(rows.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(8))), name, by="cell"), centres


def radii(indexed: DataFrame) -> dict[int, float]:
    """Each cell's largest distance of a row from its centre."""
    return {r.cell: r.radius or 0.0 for r in indexed.groupBy("cell").agg(F.max("cell_distance").alias("radius")).collect()}


def top_k(indexed: DataFrame, centres: list[list[float]], query: list[float], k: int, probes: int | None = None, radius: dict[int, float] | None = None) -> DataFrame:
    """The k nearest rows: of all that ``build`` indexed, or of the ``probes`` cells whose centres are nearest to the query.

    ``radius`` (from ``radii``) spares many searches of one index a scan each.
    """
    norm = math.sqrt(sum(x * x for x in query)) or 1.0
    unit = [x / norm for x in query]
    away = [math.dist(c, unit) for c in centres]
    order = sorted(range(len(centres)), key=away.__getitem__)
    if probes is not None:
        return _nearest(indexed, order[:probes], query, k)
    radius = radii(indexed) if radius is None else radius
    n, last = _nearest(indexed, order[:FIRST], query, k).agg(F.count("*"), F.max("distance")).first()
    # The distance of unit vectors, squared and halved, is the cosine distance; 1e-6 is more than rounding moves it.
    out = [i for i in order[FIRST:] if n == k and max(0.0, away[i] - radius.get(i, 0.0)) ** 2 / 2 > last + 1e-6]
    return _nearest(indexed, sorted(set(order) - set(out)), query, k)


def _nearest(indexed: DataFrame, cells: list[int], query: list[float], k: int) -> DataFrame:
    return vector_top_k(indexed.filter(F.col("cell").isin(*cells)), query, k)
