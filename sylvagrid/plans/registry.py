"""Registry of the runnable queries and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with its checking SQL."""
    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = with_views(sql)
        return fn
    return wrap


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded column under its own name."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, digits)
    return out.alias(c) if isinstance(c, str) else out


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)
