"""Making the package importable in Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Adds the repository to the workers' import path, for sessions started outside it.

    On a cluster the package is installed or shipped with ``--py-files``; a path
    that an executor doesn't have does no harm there.
    """
    environment = spark.sparkContext.environment
    have = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *have])
