"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelore.plans import evidence_queries, join_queries, measure_queries, nested_queries, scalar_queries, source_queries, stream_queries, structure_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (nested_queries, scalar_queries, join_queries, measure_queries, structure_queries, source_queries, stream_queries, evidence_queries)


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are called {name}")
            found[name] = query
    return found


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
