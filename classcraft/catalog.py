"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB
oracle per operator of the inventory.

Every query reads the provided tables (mostly through the `records` fixture,
orders ⋈ customer) over whole tables. Output doubles that depend on
floating-point summation order are rounded to 6 dp on both sides so the two
engines hash identically.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from classcraft.sources.tables import RECORDS_SQL


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return wrap


def records_cte(*extra: str) -> str:
    """The shared `records` CTE (plus optional further CTEs) for oracle SQL."""
    parts = [f"records AS ({RECORDS_SQL})", *extra]
    return "WITH " + ",\n".join(parts) + "\n"


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    import importlib

    for module in QUERY_MODULES:
        importlib.import_module(f"classcraft.plans.{module}")
    return REGISTRY


QUERY_MODULES = ("q_profile", "q_features", "q_metrics", "q_scoring", "q_log", "q_train")
