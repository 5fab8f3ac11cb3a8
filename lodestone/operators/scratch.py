"""Tables written to the shared folder, to cut lineage, and rows dealt out."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no folder and all runs on one machine, as in tests.
LOCAL_DIR = "/tmp/lodestone-shared"


def place(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, which driver and executors share; only a local master does without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder or LOCAL_DIR}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as Parquet in the shared folder, in a folder for each value of ``by``, read back; whoever owns the folder clears it."""
    spark = df.sparkSession
    path = place(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows of few large partitions in four for each core, by columns if given: for work that costs a task far more than moving them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame | None:
    """Tables of one schema, written one after another into one in the shared folder: what is read back is one scan, however many there are; None of none."""
    path, out = None, None
    for part in parts:
        path = path or place(part.sparkSession, name)
        part.write.mode("append").parquet(path)
        out = part
    return out.sparkSession.read.schema(out.schema).parquet(path) if out is not None else None
