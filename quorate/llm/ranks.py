"""Distributed prefix sums and smallest-key selection within groups of any size.

A group may hold a third of all rows, so no window runs over a whole group. Each
row gets a uniform 64-bit key; a group's rows fall into key ranges (buckets) of
nearly equal size, bucket totals are summed up over a small table, and only rows
of one bucket ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Key ranges per group. A bucket of a group of n rows holds about n / BUCKETS rows.
BUCKETS = 4096


def random_key(seed: int, *columns: Column) -> Column:
    """A uniform 64-bit key that depends on the seed and the columns alone."""
    return F.xxhash64(F.lit(seed), *columns)


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The range of ``key`` among ``buckets`` equal ranges, in the keys' order."""
    return F.floor((key.cast("double") + 2.0**63) / (2.0**64 / buckets)).cast("int")


def running_total(df: DataFrame, group: str, key: str, size: str, name: str, ties: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the group's rows with a smaller key.

    Ties of the key are ordered by ``ties``. Null sizes count as 0.
    """
    b = df.withColumn("__b", bucket_of(F.col(key), buckets))
    totals = b.groupBy(group, "__b").agg(F.sum(F.coalesce(size, F.lit(0))).alias("__n"))
    # One row per group and bucket: groups x 4096 rows at most.
    before = totals.select(
        group,
        "__b",
        (F.sum("__n").over(Window.partitionBy(group).orderBy("__b")) - F.col("__n")).alias("__below"),
    )
    within = Window.partitionBy(group, "__b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(before.hint("shuffle_hash"), [group, "__b"])
        .withColumn(name, F.col("__below") + F.coalesce(F.sum(F.coalesce(size, F.lit(0))).over(within), F.lit(0)))
        .drop("__b", "__below")
    )
