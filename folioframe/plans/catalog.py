"""All registered queries, area by area."""

from __future__ import annotations

from folioframe.plans import analysis, evidencing, ingest, registry, retrieval, texts  # noqa: F401


def queries():
    return {name: registry.runner(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql():
    return {name: registry.with_ctes(sql, *needs) for name, (sql, needs) in registry.ORACLES.items()}
