"""Registered queries over the driver tables, each with the SQL that checks it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("sources", "scalars", "joins", "outcomes", "scoring", "clusters", "runs")


def collect() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and all checking statements, by name."""
    queries: dict[str, Query] = {}
    checks: dict[str, str] = {}
    for module in _MODULES:
        registry = importlib.import_module(f"triagelake.catalog.{module}").REGISTRY
        queries.update(registry.queries)
        checks.update(registry.checks)
    return queries, checks
