"""All queries of the core and their SQL."""

from __future__ import annotations

from orrery.plans import geometry, problems, stores

_MODULES = [problems, geometry, stores]


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
