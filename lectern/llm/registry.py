"""Queries and SQL of all training-data operators, for __spark_entry__."""

from __future__ import annotations

from lectern.llm import chat, ctw, embeddings, fim, jaccard, langid, lines, mixing, packing, quality, resampling, sharding, topk

MODULES = [packing, langid, embeddings, lines, ctw, mixing, jaccard, quality, sharding, chat, fim, topk, resampling]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
