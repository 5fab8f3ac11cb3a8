"""Rows made of rows by a Python function, in Arrow batches that are bounded on both sides.

A row that gives many, such as a page its elements, costs a task the memory of a few of
its inputs and of one batch of results, however many rows a partition has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Bytes of a batch that Spark sends, unless the session has fewer; inputs taken from it at a time; rows and characters of a batch of results.
IN_BYTES, IN_ROWS, OUT_ROWS, OUT_CHARS = 8 << 20, 16, 4096, 4 << 20

_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_KINDS = {"int": pa.int32(), "integer": pa.int32(), "long": pa.int64(), "string": pa.string(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def bound(spark: SparkSession) -> None:
    """Lowers the session's limit of a batch's bytes to ``IN_BYTES`` where it is higher: Spark's own limit is a number of rows, whatever their size."""
    if int(spark.conf.get(_LIMIT).rstrip("bB")) > IN_BYTES:
        spark.conf.set(_LIMIT, str(IN_BYTES))


def expanded(rows: DataFrame, carried: int, make: Callable[..., Iterable[tuple]], columns: dict[str, str]) -> DataFrame:
    """The first ``carried`` columns of rows beside the ``columns`` of each tuple that ``make`` gives for the other ones; no shuffle."""
    bound(rows.sparkSession)
    schema = StructType([*rows.schema.fields[:carried], *StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in columns.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, kinds = 0, []

        def batch_of(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held, strict=True), kinds, strict=True)], names=schema.names)

        for batch in batches:
            kinds = [*batch.schema.types[:carried], *(_KINDS[k] for k in columns.values())]
            for i in range(0, len(batch), IN_ROWS):
                for row in zip(*(c.to_pylist() for c in batch.slice(i, IN_ROWS).columns), strict=True):
                    for one in make(*row[carried:]):
                        held.append((*row[:carried], *one))
                        size += sum(len(x) for x in one if isinstance(x, str))
                        if len(held) >= OUT_ROWS or size >= OUT_CHARS:
                            yield batch_of(held)
                            held, size = [], 0
        if held:
            yield batch_of(held)

    return rows.mapInArrow(run, schema)
