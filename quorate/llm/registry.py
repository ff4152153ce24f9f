"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module
from pkgutil import iter_modules

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that must agree with it."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    for m in sorted(x.name for x in iter_modules(import_module("quorate.llm").__path__)):
        if m.endswith("_queries"):
            import_module(f"quorate.llm.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")
