"""All core queries and their DuckDB counterparts, gathered from the query modules."""

from __future__ import annotations

from lattica.operators import catalogs, charts, checks, curves, dialogue, graphs, intervals, search, signals, tables, texts, timelines
from lattica import sources
from lattica.plans import flagship

MODULES = (flagship, tables, signals, intervals, charts, search, graphs, texts, timelines, catalogs, dialogue, curves, checks, sources)


def queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
