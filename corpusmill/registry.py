"""Queries of the engine's own operators and their DuckDB SQL, gathered from the modules of `plans`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import evidence, items, reports, runs, study, tables

MODULES = (items, tables, study, evidence, reports, runs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
