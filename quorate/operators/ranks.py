"""Row numbers in groups of any size.

Rows are range-partitioned by group and order, so that a group may span many
partitions; a partition's rows are numbered by themselves and moved on by the
rows of the group in earlier partitions. No group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quorate.staging import stage


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], rank: str = "rank", size: str | None = None) -> DataFrame:
    """Adds ``rank`` (from 1, ascending in ``order``, which should have no ties) and, if named, ``size``, the rows of the group.

    Null keys are a group of their own; nulls come first in order.
    """
    laid = stage(df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("__part", F.spark_partition_id()), "ranks")
    # One row per group and partition that has rows of it.
    counts = laid.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    of_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = counts.withColumn("__before", F.sum("__n").over(of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).withColumn("__size", F.sum("__n").over(of_group))
    before = before.select(*[F.col(c).alias(f"__g_{c}") for c in group], F.col("__part").alias("__p"), F.coalesce("__before", F.lit(0)).alias("__before"), "__size")
    same = F.col("__part") == F.col("__p")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    within = F.row_number().over(Window.partitionBy(*group, "__part").orderBy(*order))
    d = laid.withColumn("__w", within).join(before, same)
    return d.select(*df.columns, (F.col("__w") + F.col("__before")).alias(rank), *([F.col("__size").alias(size)] if size else []))


def running_total(df: DataFrame, order: Sequence[str], columns: Sequence[str], prefix: str = "upto_") -> DataFrame:
    """Adds for each column its total over all rows up to this one in ``order``, which should have no ties."""
    laid = stage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "totals")
    # One row per partition.
    parts = laid.groupBy("__part").agg(*[F.sum(c).alias(f"__s_{c}") for c in columns])
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select(F.col("__part").alias("__p"), *[F.coalesce(F.sum(f"__s_{c}").over(earlier), F.lit(0)).alias(f"__b_{c}") for c in columns])
    upto = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = laid.select("*", *[F.sum(c).over(upto).alias(f"__w_{c}") for c in columns]).join(before, F.col("__part") == F.col("__p"))
    return d.select(*df.columns, *[(F.col(f"__w_{c}") + F.col(f"__b_{c}")).alias(f"{prefix}{c}") for c in columns])


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, from the counts of distinct values: ``by`` and one column for each share.

    Null and NaN values count for nothing; a group without values is missing.
    """
    v = F.col(value).cast("double")
    counts = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__c"))
    # As many rows as a group has distinct values.
    w = Window.partitionBy(*by)
    c = counts.withColumn("__upto", F.sum("__c").over(w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__c").over(w))
    cells = []
    for name, q in shares.items():
        at = (F.col("__all") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        first = lambda i: F.min(F.when(F.col("__upto") > i, F.col("__v")))
        cells += [first(low).alias(f"__l_{name}"), first(high).alias(f"__h_{name}"), F.max(at - low).alias(f"__f_{name}")]
    d = c.groupBy(*by).agg(*cells)
    return d.select(*by, *[(F.col(f"__l_{n}") + (F.col(f"__h_{n}") - F.col(f"__l_{n}")) * F.col(f"__f_{n}")).alias(n) for n in shares])
