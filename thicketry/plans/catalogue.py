"""The queries by name, and the same computation in SQL where SQL can say it.

A query is registered by ``@query(name, sql)``; the modules of this folder hold them by subject.
"""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ("catalog", "vectors", "selection", "retrieval", "maps", "measures", "evaluation", "banks", "batches")
_QUERIES: dict = {}
_SQL: dict = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def _load():
    for s in SUBJECTS:
        import_module(f"thicketry.plans.{s}")


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)
