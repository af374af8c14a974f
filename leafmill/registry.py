"""Queries and SQL of the engine's own operators."""

from __future__ import annotations

from .plans import layout_queries, office_queries, pdf_queries, record_queries, scalar_queries, segment_queries, sink_queries, structure_queries, table_queries, text_queries

MODULES = (text_queries, layout_queries, record_queries, sink_queries, scalar_queries, table_queries, structure_queries, segment_queries, pdf_queries, office_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in getattr(m, "ORACLE", {}).items()}
