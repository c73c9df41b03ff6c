"""Registry of the queries run on the driver's tables, each with its oracle SQL.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, sql or None)``.
Queries without SQL are checked by row count only (and by pytest against a
sequential model on small fixtures).
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Optional[str]]] = {}


def query(name: str, sql: Optional[str] = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def load_all() -> dict:
    # importing the modules registers their queries
    from stockspark.plans import q_compare, q_imports, q_tolerance, q_book, q_mutations  # noqa: F401
    from stockspark.plans import q_lifecycle, q_admission, q_sources, q_commands, q_declared  # noqa: F401
    return QUERIES
