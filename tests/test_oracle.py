"""Every query that SQL can express against DuckDB, on whole tables."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pytest

from lodestone import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        cursor = duck.execute(sql)
        want = normal([c[0] for c in cursor.description], cursor.fetchall())
        got = normal(df.columns, rows)
        assert got[0] == want[0]
        assert got[1] == want[1]
