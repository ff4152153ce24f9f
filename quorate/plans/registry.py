"""Named queries of the core library and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that must agree with it."""

    def keep(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _ORACLES[name] = sql
        return f

    return keep


def _load() -> None:
    from quorate.plans import comments, labels, learned, models, partitions, roles, samples, selections, summaries, texts, thresholds  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def chosen(names: list[str] | None = None) -> dict[str, Query]:
    """The named queries, all without names; an unknown name is an error that lists the known ones."""
    found = queries()
    if unknown := [n for n in names or [] if n not in found]:
        raise KeyError(f"unknown queries {', '.join(unknown)}; there are {', '.join(sorted(found))}")
    return found if names is None else {n: found[n] for n in names}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
