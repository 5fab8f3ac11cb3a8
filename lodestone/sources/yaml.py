"""YAML files as rows: parsed in tasks, handed on as JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame


def parsed(files: DataFrame) -> DataFrame:
    """(file_path, data) of files (file_path, text): their content as JSON; files that don't parse or are empty are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["file_path"], batch["text"], strict=True):
                try:
                    found = yaml.safe_load(text)
                except yaml.YAMLError:
                    found = None
                if found:
                    rows.append((path, json.dumps(found, default=str, sort_keys=True)))
            yield pd.DataFrame(rows, columns=["file_path", "data"])

    return files.select("file_path", "text").mapInPandas(run, "file_path string, data string")
