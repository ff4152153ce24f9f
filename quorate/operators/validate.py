"""Contracts of a table, checked by one aggregation that names what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_no_nulls(df: DataFrame, names: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first().asDict()
    if bad := {n: c for n, c in counts.items() if c}:
        raise ValueError(f"null values: {bad}")
    return df


def require_domain(df: DataFrame, name: str, values: Sequence[str]) -> DataFrame:
    found = [r[0] for r in df.where(~F.coalesce(F.col(name).isin(list(values)), F.lit(False))).select(name).distinct().limit(5).collect()]
    if found:
        raise ValueError(f"{name} has other values: {found}")
    return df


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    if found := duplicate_keys(df, key).limit(5).collect():
        raise ValueError(f"repeated keys: {[tuple(r)[:-1] for r in found]}")
    return df


def dependents(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Keys whose rows do not agree on the columns; null counts as a value."""
    many: list[Column] = [F.count_distinct(F.coalesce(n, F.lit(""))).alias(f"n_{n}") for n in names]
    wrong = " OR ".join(f"n_{n} > 1" for n in names)
    return df.groupBy(key).agg(*many).where(wrong)


def require_schema(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """The table, or an error that names columns that are missing or of another type."""
    have = dict(df.dtypes)
    if bad := {n: have.get(n, "missing") for n, t in schema.items() if have.get(n) != t}:
        raise ValueError(f"columns of other types: {bad}")
    return df


def require_shares(df: DataFrame, label: str, shares: dict[object, float], tolerance: float) -> DataFrame:
    """The table, or an error if a label's share of the rows is farther than ``tolerance`` from the given one, as after a split."""
    n = {r[0]: r[1] for r in df.groupBy(label).agg(F.count("*")).where(F.col(label).isin(list(shares))).collect()}
    total = df.count()
    if bad := {k: n.get(k, 0) / total if total else None for k, s in shares.items() if not total or abs(n.get(k, 0) / total - s) > tolerance}:
        raise ValueError(f"shares off: {bad}")
    return df


def require_measure(df: DataFrame, gold: str, predicted: str, accuracy: float, tolerance: float = 1e-6) -> DataFrame:
    """The table, or an error if its predictions do not have the accuracy that a run reported."""
    found = df.agg(F.avg((F.col(gold) == F.col(predicted)).cast("int"))).first()[0]
    if found is None or abs(found - accuracy) > tolerance:
        raise ValueError(f"accuracy {found}, reported {accuracy}")
    return df


def require_cover(df: DataFrame, parts: Sequence[DataFrame], key: str) -> None:
    """An error unless the parts are disjoint and make up the keys of the table."""
    counted = None
    for p in parts:
        counted = p.select(key) if counted is None else counted.unionByName(p.select(key))
    counted = counted.groupBy(key).agg(F.count("*").alias("n"))
    whole = df.select(key).distinct().withColumn("w", F.lit(1))
    bad = whole.join(counted, key, "full").where("w IS NULL OR n IS NULL OR n > 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys not in exactly one part: {[r[0] for r in bad]}")


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if found := a.join(b, key, "left_semi").select(key).limit(5).collect():
        raise ValueError(f"in both parts: {[r[0] for r in found]}")
