"""Queries of the training-data operators, by name."""

from __future__ import annotations

from tallyframe.llm import queries_audit, queries_dedup, queries_text

MODULES = (queries_text, queries_dedup, queries_audit)


def queries() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
