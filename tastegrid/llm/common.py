"""Helpers shared by the training-data operators."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tastegrid.session import ensure_checkpoint_dir, ship_package
from tastegrid.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The white space that separates words and is stripped from lines: blank, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as query ``name``; ``sql`` is its DuckDB twin."""
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def text_or_empty(name: str = "text") -> Column:
    """The text column, null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters outside ``SPACE``."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the written rows.

    Used where a result is read more than once; the files survive a lost executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shielded(*named: str):
    """Decorator: ``fn(df, ...)`` sees the columns of ``df`` under names that its own cannot clash with.

    ``named`` are the parameters that name columns.  Of the result's columns, those of ``df`` get their names back, but for
    the ones whose names the function adds: these are replaced.
    """
    def deco(fn):
        signature = inspect.signature(fn)

        @functools.wraps(fn)
        def run(df: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature.bind(df, *args, **kwargs)
            bound.apply_defaults()
            names = df.columns
            safe = [f"in_{i}" for i in range(len(names))]
            for p in named:
                bound.arguments[p] = safe[names.index(bound.arguments[p])]
            bound.arguments[next(iter(signature.parameters))] = df.toDF(*safe)
            out = fn(*bound.args, **bound.kwargs)
            back = dict(zip(safe, names, strict=True))
            added = {c.lower() for c in out.columns if c not in back}
            return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns if c not in back or back[c].lower() not in added))
        return run
    return deco


def quoted(text: str) -> str:
    """``text`` as an SQL string literal without escapes."""
    return "'" + text.replace("'", "''") + "'"
