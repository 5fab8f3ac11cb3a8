"""Folders of configuration files: which one is read, what it names, and the parsed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.folder import Folder
from lodestone.sources import yaml

# The ending of a configuration file, and how many are given at most unless more are asked for.
ENDING, LIMIT = ".yml", 500


def first_folder(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first of the candidate folders that exists."""
    return next((c for c in candidates if Folder(spark, c).exists("")), None)


def named(files: DataFrame, prefix: str = "", limit: int = LIMIT) -> DataFrame:
    """(name, and the files' columns) of the configuration files right in a folder (file_path, relative), by name: those that start with a prefix, the first ``limit`` of them (0: all)."""
    rows = files.filter(F.col("file_path").endswith(ENDING) & ~F.col("file_path").contains("/"))
    found = rows.select(F.expr(f"substring(file_path, 1, length(file_path) - {len(ENDING)})").alias("name"), *files.columns).filter(F.col("name").startswith(prefix)).orderBy("name")
    return found.limit(limit) if limit else found


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, text) of the configuration files in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ENDING}").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def loaded(files: DataFrame, prefix: str = "", limit: int = LIMIT) -> DataFrame:
    """(name, data) of configuration files (file_path, text), parsed; those that don't parse are left out."""
    chosen = named(files, prefix, limit)
    return yaml.parsed(chosen).withColumn("name", F.expr(f"substring(file_path, 1, length(file_path) - {len(ENDING)})")).select("name", "data")
