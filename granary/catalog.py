"""Registry of the retail queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.plans import retail, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return retail.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
