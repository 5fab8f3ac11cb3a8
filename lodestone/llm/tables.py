"""Reading inputs, and cutting lineage with tables written to the shared folder."""

from __future__ import annotations

import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used where the session names no folder and all runs on one machine, as in tests.
LOCAL_DIR = "/tmp/lodestone-shared"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; only a local master does without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_DIR


class Owned:
    """What is written within a ``with`` block goes at its end, but for the tables that are kept for whoever owns the block around it.

    A table may go once nothing that is still to run reads it: what a block hands on is made of kept tables and inputs alone.
    """

    blocks: ClassVar[list[Owned]] = []

    def __init__(self):
        self.paths: dict[str, SparkSession] = {}
        self.kept: set[str] = set()

    def __enter__(self) -> Owned:
        self.blocks.append(self)
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {getattr(t, "_lodestone_path", "") for t in tables}

    def __exit__(self, *_) -> None:
        self.blocks.remove(self)
        for path, spark in self.paths.items():
            if path in self.kept:
                if self.blocks:
                    self.blocks[-1].paths[path] = spark
            else:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    Later jobs read replicated files instead of recomputing, and a lost executor
    loses none of it.  Within a block of ``Owned`` the table goes when the block ends;
    else the folder is scratch, and whoever owns it clears it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if Owned.blocks:
        Owned.blocks[-1].paths[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def column(name: str) -> Column:
    """The column of that very name, whatever its characters."""
    return F.col(f"`{name.replace('`', '``')}`")


def plain(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """df with the columns not in ``keep`` renamed by their place, so that no name, whatever its characters or case, meets another.

    ``toDF`` with the first names undoes it.
    """
    return df.toDF(*(c if c in keep else f"_x{i}" for i, c in enumerate(df.columns)))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
