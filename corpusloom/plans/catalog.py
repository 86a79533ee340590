"""All registered queries of the library with their SQL statements."""

from __future__ import annotations

from corpusloom.plans import ops_queries, search_queries, store_queries, text_queries, train_queries
from corpusloom.plans._registry import Query

MODULES = [text_queries, search_queries, ops_queries, train_queries, store_queries]


def queries() -> dict[str, Query]:
    names = [name for m in MODULES for name in m.R.queries]
    if len(names) > len(set(names)):
        raise ValueError(f"registered twice: {sorted({n for n in names if names.count(n) > 1})}")
    return {name: f for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.sql.items()}
