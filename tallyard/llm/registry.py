"""All queries of this folder and, where SQL can say the same, their SQL."""

from __future__ import annotations

from importlib import import_module

from ..scratch import with_package

_NAMES = ["topn", "components", "lexicon", "knn", "overlap", "leak", "subjects"]
_MODULES = [import_module(f".{n}", __package__) for n in _NAMES]


def queries() -> dict:
    return {k: with_package(f) for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
