"""All queries of the survey engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans import queries_data, queries_files, queries_stream, queries_survey, queries_tables

MODULES = (queries_tables, queries_data, queries_survey, queries_stream, queries_files)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict = {}
    for module in MODULES:
        found |= module.QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict = {}
    for module in MODULES:
        found |= module.ORACLES
    return found
