"""All registered queries of the market library and their oracles."""

from __future__ import annotations

from barloom.plans import indicator_queries, market_queries, sketch_queries, structure_queries

MODULES = [indicator_queries, structure_queries, market_queries, sketch_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
