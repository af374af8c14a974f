"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import chat_format, decontamination, html_extract, lm_scoring, mixing, quality_cnn, quality_rules, simhash, substring_dedup, token_counts

MODULES = (chat_format, simhash, substring_dedup, quality_cnn, token_counts, lm_scoring, quality_rules, mixing, decontamination, html_extract)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in getattr(m, "ORACLE", {}).items()}
