"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tastegrid.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is its DuckDB equivalent."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    # Importing the modules registers their queries.
    from tastegrid.plans import q_prepare  # noqa: F401
    for mod in ("q_content", "q_cf", "q_hybrid", "q_eval", "q_profiles", "q_activity", "q_stream", "q_files"):
        try:
            __import__(f"tastegrid.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tastegrid.plans.{mod}":
                raise
