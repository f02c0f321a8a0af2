"""The queries of the library's own operators, by key, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: list[str] = ["text", "ledger", "people", "layout", "streams", "more", "stateful", "documents", "evidence"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(f"tramaline.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= import_module(f"tramaline.plans.{name}").SQL
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["inconsistent_terms"](spark, sf_dir)
