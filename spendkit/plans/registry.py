"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of the views under `name`; `sql` states the same result."""

    def register(build: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Views(spark, sf_dir))
        if sql:
            CHECKS[name] = with_views(sql)
        return build

    return register


def dbl(name: str | Column, alias: str | None = None, digits: int | None = None) -> Column:
    """A number as double, rounded if asked, for comparison."""
    c = (F.col(name) if isinstance(name, str) else name).cast("double")
    if digits is not None:
        c = F.round(c, digits)
    return c.alias(alias or name)


def big(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("bigint").alias(alias or name)
