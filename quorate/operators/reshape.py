"""Texts by role, joins under several roles, pivots, and reconciliations of two tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.text import normalized, text_hash


def instances(df: DataFrame, key: str, roles: Mapping[str, str]) -> DataFrame:
    """Wide to long: (key, role, text, text_hash), once for each key, role and hash; blank texts drop out.

    Of texts with the same hash the smallest is kept.
    """
    pairs = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("text")) for r, c in roles.items()])
    long = df.where(F.col(key).isNotNull()).select(key, F.explode(pairs).alias("p")).select(key, "p.role", "p.text").where(normalized("text") != "")
    return long.withColumn("text_hash", text_hash("text")).groupBy(key, "role", "text_hash").agg(F.min("text").alias("text"))


def join_roles(df: DataFrame, roles: Mapping[str, str], side: DataFrame, on: str, value: str) -> DataFrame:
    """Left-joins one table under several roles: for each role the column that holds its key becomes ``role_value``.

    ``side`` must have one row per ``on``; it is joined as a whole, once per role.
    """
    for role, column in roles.items():
        df = df.join(side.select(F.col(on).alias(column), F.col(value).alias(f"{role}_{value}")), column, "left")
    return df


def coverage(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows with and without ``value`` per group, and the share that has it."""
    return df.groupBy(*by).agg(F.count(value).alias("n_hit"), F.count_if(F.col(value).isNull()).alias("n_miss"), F.round(F.count(value) / F.count("*"), 6).alias("share"))


def resolved(df: DataFrame, key: str, value: str, tiers: Mapping[str, DataFrame], make: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``value`` and ``tier``: from the first tier, a table of (key, value), that has the key; what none has is made, or has null and ``missing``.

    ``make`` gets the distinct keys that are left, with the columns of ``df``, and
    gives (key, value). Each tier is asked only for what the ones before lack.
    """
    asked, found = df.where(F.col(key).isNotNull()).dropDuplicates([key]), None
    for name, tier in tiers.items():
        hit = asked.select(key).join(tier.select(key, value), key).select(key, value, F.lit(name).alias("tier"))
        found = hit if found is None else found.unionByName(hit)
        asked = asked.join(tier.select(key), key, "left_anti")
    if make is not None:
        made = make(asked).select(key, value, F.lit("made").alias("tier"))
        found = made if found is None else found.unionByName(made)
    return df.join(found, key, "left").withColumn("tier", F.coalesce("tier", F.lit("missing")))


def require_covered(df: DataFrame, value: str) -> DataFrame:
    """The table, or an error with the number of rows without ``value``."""
    n = df.where(F.col(value).isNull()).count()
    if n:
        raise ValueError(f"{n} rows without {value}")
    return df


def wide(df: DataFrame, key: str, column: str, values: Sequence[str], value: str, order: str) -> DataFrame:
    """Long to wide with given columns: of several rows of a cell the first by ``order``; null where there is none."""
    cells = [F.min_by(F.when(F.col(column) == v, F.col(value)), F.when(F.col(column) == v, F.col(order))).alias(v.replace("-", "_")) for v in values]
    return df.groupBy(key).agg(*cells)


def reconcile(expected: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """(key, reason): ``same``, ``changed``, ``missing`` (not stored) or ``unexpected``, by a full outer join on unique keys."""
    e = expected.select(key, F.col(value).alias("e"), F.lit(1).alias("in_e"))
    s = stored.select(key, F.col(value).alias("s"), F.lit(1).alias("in_s"))
    reason = F.when(F.col("in_s").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(F.col("e").eqNullSafe(F.col("s")), "same").otherwise("changed")
    return e.join(s, key, "full").select(key, reason.alias("reason"))


def repaired(df: DataFrame, key: str, by: Sequence[str], known: DataFrame) -> DataFrame:
    """Adds ``repaired``: the key where ``known`` has it, else the one key that ``known`` has for the columns ``by``, else null.

    ``known`` is deduplicated by key and then by the columns; ambiguous ones name no key.
    """
    ids = known.select(F.col(key).alias("__id")).where("__id IS NOT NULL").distinct().withColumn("there", F.lit(True))
    lookup = known.where(F.col(key).isNotNull()).groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.min(key).alias("one"), F.count_distinct(key).alias("n")).where("n = 1").drop("n")
    d = df.join(ids, df[key] == ids["__id"], "left").drop("__id")
    d = d.join(lookup, [d[c] == lookup[f"__{c}"] for c in by], "left").drop(*[f"__{c}" for c in by])
    return d.withColumn("repaired", F.when(F.col("there"), F.col(key)).otherwise(F.col("one"))).drop("there", "one")


def in_order(df: DataFrame, key: str, ids: Column, name: str = "position") -> Column:
    """Place of the key in a list of ids (from 1), null where it is not in it."""
    return F.when(F.array_contains(ids, F.col(key)), F.array_position(ids, F.col(key))).alias(name)


def zipped(a: Column, b: Column) -> Column:
    """Two lists by position; lists of different lengths are an error."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a, b)).otherwise(F.raise_error(F.lit("lists of different lengths")))
