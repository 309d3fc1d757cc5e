"""All registered queries of the engine and their SQL twins."""

from __future__ import annotations

from lectern.plans import flow_queries, service_queries, store_queries, text_queries

MODULES = [text_queries, flow_queries, service_queries, store_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
