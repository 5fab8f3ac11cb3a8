"""The library's own queries and their DuckDB oracle, by family."""

from __future__ import annotations

from collections.abc import Callable

from lodestone.plans import catalogs, extras, graphs, lookups, operations, retrieval, texts

FAMILIES = (retrieval.R, graphs.R, operations.R, texts.R, catalogs.R, extras.R, lookups.R)

#: Fused hybrid retrieval.
FLAGSHIP = retrieval.search_hybrid


def queries() -> dict[str, Callable]:
    return {name: query for family in FAMILIES for name, query in family.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.sql.items()}
