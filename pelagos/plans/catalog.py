"""All queries of the library by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pelagos.plans import catalogues, checks, extraction, feeds, places, rasters, reconcile, restrictions, series, stateful

_MODULES = [restrictions, catalogues, places, series, reconcile, extraction, stateful, checks, feeds, rasters]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
