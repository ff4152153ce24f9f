"""Counts, proportions and summaries of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.ranks import quantiles


def with_proportion(counts: DataFrame, within: Sequence[str], n: str = "n", name: str = "proportion", digits: int = 4) -> DataFrame:
    """Adds each row's share of its group's count; null where that is 0. ``counts`` is pre-aggregated."""
    total = F.sum(n).over(Window.partitionBy(*within))
    return counts.withColumn(name, F.when(total > 0, F.round(F.col(n) / total, digits)))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by the given values of ``column``, 0 where there are none, and their total."""
    cells = [F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values]
    return df.groupBy(row).agg(*cells, F.count_if(F.col(column).isin(list(values))).alias("n_total"))


def rate(df: DataFrame, by: Sequence[str], hit: Column, name: str = "rate") -> DataFrame:
    """Rows, hits and rate per group, with the half-width of the rate's 95 % interval."""
    x = hit.cast("double")
    half = 1.96 * F.stddev_samp(x) / F.sqrt(F.count(x))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(x).cast("long").alias("n_hit"), F.round(F.avg(x), 6).alias(name), F.round(half, 6).alias("half_width"))


def cube_means(df: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Means over all combinations of the keys, ``all`` where a key is rolled up; rows with a null or blank key drop out."""
    keys = [F.when(F.grouping(k) == 1, "all").otherwise(F.col(k)).alias(k) for k in by]
    out = df.where(" AND ".join(f"trim({k}) != ''" for k in by)).cube(*[F.col(k) for k in by])
    return out.agg(*[k.alias(f"__{n}") for k, n in zip(keys, by, strict=True)], F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in measures]).select(*[F.col(f"__{n}").alias(n) for n in by], "n", *[f"mean_{m}" for m in measures])


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, median, deviation and upper quartile; quantiles interpolate and come from counts of the values."""
    v = F.col(value)
    means = df.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"))
    parts = quantiles(df, by, value, {"__median": 0.5, "__p75": 0.75}).select(*[F.col(c).alias(f"__g_{c}") for c in by], "__median", "__p75")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return means.join(parts, same, "left").select(*by, "n", "mean", F.round("__median", 6).alias("median"), "sd", F.round("__p75", 6).alias("p75"))


def complete(counts: DataFrame, keys: dict[str, Sequence[str]], n: str = "n") -> DataFrame:
    """A row for every combination of the given key values, 0 where ``counts`` has none."""
    spark = counts.sparkSession
    grid: list[tuple[str, ...]] = [()]
    for values in keys.values():
        grid = [(*g, v) for g in grid for v in values]
    rows = spark.createDataFrame(grid, ", ".join(f"{k} string" for k in keys))
    return rows.join(counts, list(keys), "left").withColumn(n, F.coalesce(n, F.lit(0)))


def enrichment(counts: DataFrame, term: str, a: str, b: str, total_a: int, total_b: int) -> DataFrame:
    """Ratio of the terms' smoothed rates in two buckets."""
    rate_a = (F.col(a) + 0.5) / (total_a + 1e-9)
    rate_b = (F.col(b) + 0.5) / (total_b + 1e-9)
    return counts.select(term, a, b, F.round(rate_a / rate_b, 6).alias("ratio"))


def margins(df: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """Counts over all combinations of the keys and their margins: ``all`` where a key is rolled up, ``<NA>`` for null."""
    keys = [F.when(F.grouping(k) == 1, "all").otherwise(F.coalesce(F.col(k), F.lit("<NA>"))).alias(f"__{k}") for k in by]
    return df.cube(*[F.col(k) for k in by]).agg(*keys, F.count("*").alias(n)).select(*[F.col(f"__{k}").alias(k) for k in by], n)
