"""Named queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.catalog import Catalog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

KEY = ("k_order", "k_line", "k_part", "k_supp")


def query(name: str, sql: str | None = None):
    """Register ``fn(catalog) -> DataFrame`` under ``name``, with its check SQL if there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: fn(Catalog(spark, root))
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


def rnd(c, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def day(c="DATE") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def big(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")
