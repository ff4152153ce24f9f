"""One row per key, top rows per group, and batches in a given order.

Row order is never relied on: each operator takes the columns that define it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.ranks import ranked


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that is first in ``order``, by partial aggregation: no key is gathered in one task."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row that is last in ``order``."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank; Spark prunes groups before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def batches(df: DataFrame, group: Sequence[str], order: Sequence[str], size: int, whole_only: bool = False, name: str = "batch_id") -> DataFrame:
    """Numbers rows 0.. in ``order`` and divides them by ``size``; with ``whole_only`` an incomplete last batch drops out."""
    d = ranked(df, group, order, "__i", "__n").withColumn("__i", F.col("__i") - 1)
    if whole_only:
        d = d.where(F.col("__i") < F.col("__n") - F.col("__n") % size)
    return d.withColumn(name, F.floor(F.col("__i") / size).cast("int")).drop("__i", "__n")
