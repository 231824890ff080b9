"""The registered queries of this package."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import importlib

    for module in ("shape_queries", "language_queries", "fingerprint_queries", "word_queries"):
        importlib.import_module(f"folioscope.llm.{module}")
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    all_queries()
    return dict(ORACLES)
