"""Registry of named queries: a Spark plan and, where SQL can say it, a DuckDB twin.

Each Spark query takes (spark, sf_dir) and returns a DataFrame over the
driver's tables or views derived from them. The twin is independent SQL
over the same parquet tables; column names match so results can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from tessera.plans import (q_access, q_audit, q_changes, q_integrity,  # noqa: F401
                               q_matching, q_movement, q_reports, q_streams)
