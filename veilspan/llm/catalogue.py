"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("overlap", "sample", "secrets", "forms", "personal", "quantiles", "encoding", "mixture", "spam")


def _parts(name: str) -> dict:
    """What the modules register under a name; a module that cannot be imported is an error."""
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"veilspan.llm.{module}"), name, {})
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _parts("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _parts("SQL")
