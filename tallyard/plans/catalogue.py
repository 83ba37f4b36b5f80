"""All queries of the library's core and the SQL that each must equal."""

from __future__ import annotations

from ..scratch import with_package
from . import model_queries, org_queries, rank_queries, skewed_repos, storage_queries, table_queries, text_queries, vector_queries

_MODULES = [vector_queries, text_queries, org_queries, rank_queries, table_queries, model_queries, skewed_repos, storage_queries]


def queries() -> dict:
    return {k: with_package(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
