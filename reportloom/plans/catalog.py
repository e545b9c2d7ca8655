"""Registry of the queries: each has a Spark plan and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.plans.views import Views, checking_sql

Plan = Callable[[Views], DataFrame]

_PLANS: dict[str, Plan] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register the decorated plan under its own name, with the SQL that must give the same rows."""

    def register(plan: Plan) -> Plan:
        _PLANS[plan.__name__] = plan
        if sql is not None:
            _SQL[plan.__name__] = checking_sql(sql)
        return plan

    return register


def _load() -> None:
    from reportloom.plans import (  # noqa: F401
        comparisons,
        databooks,
        lookups,
        normalising,
        quality_checks,
        searches,
        sources,
        statistics,
        stored,
        windows,
    )


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bound(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: plan(Views(spark, folder))

    return {name: bound(plan) for name, plan in _PLANS.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def double(name: str) -> Column:
    return F.col(name).cast("double").alias(name)


def joined(values: str | Column) -> Column:
    """Array as one text, nulls shown as ``~``."""
    return F.array_join(values, "|", "~")
