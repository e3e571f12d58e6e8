"""All queries over the driver's tables, and their SQL where SQL can say them."""

from __future__ import annotations

from tessera.plans import long_series, models, people, relational, simulation

MODULES = (relational, long_series, simulation, people, models)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
