"""Registered queries: a name, a function of (spark, folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def load() -> None:
    for name in ("board", "summaries", "agreement", "curves", "preparation", "matching", "grids", "resampling", "gates", "trees", "stages", "planes", "corpus", "files", "records", "rules", "intake"):
        importlib.import_module(f"assayer.operators.{name}")
