"""The registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspan.plans import core_queries, form_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return core_queries.QUERIES | form_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return core_queries.SQL | form_queries.SQL
