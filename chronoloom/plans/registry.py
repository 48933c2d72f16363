"""All queries outside the llm subpackage, by name, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoloom.plans import binding_queries, curve_queries, detail_queries, general, join_queries, program_queries, state_queries, text_queries

_MODULES = [binding_queries, curve_queries, join_queries, text_queries, state_queries, program_queries, detail_queries, general]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        out |= m.SQL
    return out
