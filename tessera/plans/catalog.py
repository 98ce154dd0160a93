"""Registry of the named queries of the core."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules of this package with QUERIES and ORACLES.
MODULES = ("packed", "text", "filters", "joins", "windows", "ranking", "requests", "aggregates", "evidence", "gates", "streams", "stores", "selection")


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"tessera.plans.{name}"), what)
    return out


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return queries()["RNK-01"](spark, directory)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracles() -> dict[str, str]:
    return _gather("ORACLES")
