"""All registered queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import dossier, evaluation, extraction, functions, metrics, records, reports, resolution, retrieval, texts

Query = Callable[[SparkSession, str], DataFrame]
_modules = [functions, evaluation, retrieval, texts, extraction, metrics, dossier, reports, records, resolution]


def queries() -> dict[str, Query]:
    """Name to callable of every registered query."""
    return {k: v for m in _modules for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL of every query that SQL can express."""
    return {k: v for m in _modules for k, v in m.ORACLE.items()}
