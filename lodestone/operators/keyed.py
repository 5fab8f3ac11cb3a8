"""Tables of rows by key that take batches of changes.

Rows lie in folders by a hash bucket of their key, in layers: a batch is written
once, into the buckets that it touches, as a layer over what is there.  A reader
takes of each key the row of the last layer; buckets of one layer are read as they
are.  A bucket that has ``LAYERS`` of them is merged into one by the next batch, so the
bytes written grow with the batches.  Where buckets grow beyond ``BUCKET_BYTES`` on
average, the next batch deals all rows into twice as many.

Each state of the table is a numbered commit: readers see whole batches, of two
writers on one state the second fails, and so does one whose lease is gone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from lodestone.operators.folder import Commits, Folder
from lodestone.operators.incremental import current

LAYERS, BUCKET_BYTES = 8, 256 << 20


class Keyed:
    """A table of ``schema`` whose rows are known by ``key``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16, guard: Callable[[], None] | None = None):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.folder = Folder(spark, path)
        self.commits = Commits(self.folder, guard)

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()

    def version(self) -> int:
        return self.commits.last()[0]

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int").alias("_bucket")

    def _stored(self, layers: list[tuple[int, str]]) -> DataFrame:
        """The rows of some layers, with the number of the layer (_v), whether they are gone (_gone), and their bucket."""
        schema = StructType([*self.schema.fields]).add("_gone", BooleanType()).add("_v", LongType()).add("_bucket", IntegerType())
        if not layers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(*(f"{self.path}/_v={v}/_bucket={b}" for v, b in layers))

    def _merged(self, layers: dict[str, list[int]]) -> DataFrame:
        """The rows that count, of these buckets (with _bucket)."""
        names = [*self.columns, "_bucket"]
        single = self._stored([(v[0], b) for b, v in layers.items() if len(v) == 1]).filter("NOT _gone").select(*names)
        several = {b: v for b, v in layers.items() if len(v) > 1}
        if not several:
            return single
        above = current(self._stored([(x, b) for b, v in several.items() for x in v[1:]]), self.key, "_v")
        below = self._stored([(v[0], b) for b, v in several.items()]).filter("NOT _gone").join(above.select(*self.key), self.key, "left_anti")
        return single.unionByName(below.select(*names)).unionByName(above.filter("NOT _gone").select(*names))

    def read(self) -> DataFrame:
        """The rows of the last commit."""
        return self._merged(self.commits.last()[1].get("layers", {})).select(*self.columns)

    def at(self, *key) -> DataFrame:
        """The row of one key: one bucket is read."""
        state = self.commits.last()[1]
        if not state:
            return self.read()
        one = self.spark.createDataFrame([key], StructType([self.schema[k] for k in self.key]))
        bucket = str(one.select(self._bucket(state["buckets"])).first()[0])
        rows = self._merged({b: v for b, v in state["layers"].items() if b == bucket})
        for k, x in zip(self.key, key, strict=True):
            rows = rows.filter(F.col(k) == x)
        return rows.select(*self.columns)

    def change(self, put: DataFrame | None = None, gone: DataFrame | None = None) -> int:
        """Writes rows (keys distinct; columns that they lack are null) and forgets keys, of which those also in ``put`` stay; the commit's number."""
        before, state = self.commits.last()
        buckets, layers = state.get("buckets", self.buckets), state.get("layers", {})
        rows = self.spark.createDataFrame([], self.schema).withColumn("_gone", F.lit(False))
        if put is not None:
            rows = put.select(*(F.col(f.name) if f.name in put.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(False).alias("_gone"))
        if gone is not None:
            out = gone.select(*self.key).distinct()
            out = out.join(put.select(*self.key), self.key, "left_anti") if put is not None else out
            rows = rows.unionByName(out.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        merging = [b for b, v in layers.items() if len(v) >= LAYERS]
        if state.get("bytes", 0) > buckets * BUCKET_BYTES:
            buckets, merging = 2 * buckets, list(layers)
        rows = rows.withColumn("_bucket", self._bucket(buckets))
        if merging:
            old = self._merged({b: layers[b] for b in merging}).withColumn("_gone", F.lit(False)).withColumn("_bucket", self._bucket(buckets))
            rows = old.join(rows.select(*self.key), self.key, "left_anti").unionByName(rows)
        n = before + 1
        place = f"_v={n}"
        rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{place}")
        written = [x.split("=")[1] for x in self.folder.names(place) if x.startswith("_bucket=")]
        base = {b: v for b, v in layers.items() if b not in merging}
        new = base | {b: [*base.get(b, []), n] for b in written}
        size = self.folder.size(place)
        kept = state.get("bytes", 0) + size if not (merging and len(merging) == len(layers)) else size
        return self.commits.add(before, {"buckets": buckets, "layers": new, "bytes": kept, "written": size})

    def vacuum(self) -> list[int]:
        """Removes layers that the last commit doesn't read; readers of earlier commits lose them. Gives their numbers."""
        used = {v for layers in self.commits.last()[1].get("layers", {}).values() for v in layers}
        old = [int(x[3:]) for x in self.folder.names() if x.startswith("_v=") and int(x[3:]) not in used]
        last = self.commits.last()[0]
        old = [v for v in old if v <= last]  # a later one is being written
        for v in old:
            self.folder.delete(f"_v={v}")
        for n in self.folder.names("_commits"):
            if n.isdigit() and int(n) < last:
                self.folder.delete(f"_commits/{n}")
        return old
