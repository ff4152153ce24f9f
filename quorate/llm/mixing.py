"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule: points (t, w) over training time 0..1, linear
in between. A source's cumulative demand is the integral of its schedule times
the size of the mix; inverting it assigns every copy of a record the training
position at which its tokens are due. Records are range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.functions.keys import folded, usable
from quorate.llm.ranks import random_key, running_total
from quorate.staging import stage

Schedule = Sequence[tuple[float, float]]

#: A constant weight throughout.
CONSTANT: Schedule = ((0.0, 1.0), (1.0, 1.0))


def budget(sized: DataFrame, source: str, size: str, weights: DataFrame) -> DataFrame:
    """One row per row of ``weights`` (source, target_share, max_repeats).

    ``total`` tokens of all records (those without source count), ``supply`` the
    source's own, ``demand`` its share of the total, ``granted`` what it can
    contribute when no record appears more than ``max_repeats`` times, and
    ``short`` whether that is less than the demand. Sources compare without outer
    white space and in lower case; a null share or repeat count counts as 0.
    A weight row without a usable source has no supply. Empty tables give
    totals of 0 and no shortfall of a zero demand.
    """
    counted = sized.groupBy(F.when(usable(source), folded(source)).alias("__s")).agg(F.sum(F.coalesce(size, F.lit(0))).cast("long").alias("supply"), F.count("*").alias("records"))
    # One row per source; staged so that the total, one number, costs no second pass.
    by = stage(counted, "mix-supply")
    total = by.agg(F.coalesce(F.sum("supply"), F.lit(0))).first()[0]
    w = weights.select(
        folded("source").alias("source"),
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).cast("long").alias("max_repeats"),
    )
    named = by.where(F.col("__s").isNotNull()).withColumnRenamed("__s", "source")
    return (
        w.join(named, "source", "left")
        .withColumn("total", F.lit(total))
        .withColumn("supply", F.coalesce("supply", F.lit(0)))
        .withColumn("records", F.coalesce("records", F.lit(0)))
        .withColumn("demand", F.col("target_share") * F.col("total"))
        .withColumn("granted", F.least(F.col("demand"), (F.col("supply") * F.col("max_repeats")).cast("double")))
        .withColumn("short", (F.col("supply") * F.col("max_repeats")).cast("double") < F.col("demand"))
    )


def due(schedule: Schedule, part: Column) -> Column:
    """Training time 0..1 at which a source has been asked for ``part`` (0..1) of its tokens.

    The cumulative weight is quadratic between two points of the schedule, so
    its inverse is the root of a quadratic.
    """
    points = [(float(t), float(w)) for t, w in schedule]
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False)]
    if points[0][0] != 0 or points[-1][0] != 1 or min(w for _, w in points) < 0 or sum(areas) <= 0 or any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise ValueError("a schedule runs from time 0 to 1, rising, with weights of at least 0 that are not all 0")
    whole = sum(areas)
    found = F.lit(1.0)
    end = whole
    for (t0, w0), (t1, w1), area in reversed(list(zip(points, points[1:], areas, strict=False))):
        begin = end - area
        rest = part * whole - begin
        slope = (w1 - w0) / (t1 - t0)
        if abs(slope) < 1e-12:
            at = F.lit(t0) + (rest / w0 if w0 else F.lit(0.0))
        else:
            at = F.lit(t0) + (F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))) - w0) / slope
        found = F.when(part * whole <= end, F.greatest(F.lit(t0), F.least(F.lit(t1), at))).otherwise(found)
        end = begin
    return found


def mix(sized: DataFrame, key: str, source: str, size: str, plan: DataFrame, schedules: Mapping[str, Schedule] | None = None, seed: int = 42) -> DataFrame:
    """The records of the mix: key, source, copy (from 1), size and position.

    ``plan`` comes from :func:`budget`. A source's records follow each other in
    random order; the whole order is repeated until the granted tokens are used
    up. The record in which they end is kept whole. Records without source, of a
    source without weight, or of no tokens do not appear. Positions are the due
    times of a copy's first token, spread over the whole mix.
    """
    p = plan.where("granted > 0").select("source", "supply", "granted")
    rows = sized.select(F.col(key), folded(source).alias("source"), F.col(size).cast("long").alias("size")).where("size > 0 AND source IS NOT NULL")
    rows = rows.withColumn("__k", random_key(seed, F.col(key), F.col("source")))
    # A handful of sources with weights: the plan has one row per weight row.
    rows = rows.join(F.broadcast(p.select("source")), "source", "left_semi")
    ordered = running_total(rows, "source", "__k", "size", "__before", [key])
    copies = F.ceil((F.col("granted") - F.col("__before")) / F.col("supply"))
    placed = (
        ordered.join(F.broadcast(p), "source")
        .withColumn("__copies", copies.cast("int"))
        .where("__copies >= 1")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
        .withColumn("__part", ((F.col("copy") - 1) * F.col("supply") + F.col("__before")) / F.col("granted"))
    )
    at = due(CONSTANT, F.col("__part"))
    for name, schedule in sorted((schedules or {}).items()):
        at = F.when(F.col("source") == name.strip().lower(), due(schedule, F.col("__part"))).otherwise(at)
    return placed.select(key, "source", "copy", "size", at.alias("position")).orderBy("position", "source", key, "copy")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual share of each source of the plan.

    ``actual_share`` is of the mix's tokens; 0 where the source has none.
    """
    by = mixed.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("copies"), F.max("copy").alias("most_copies"))
    # A window over the rows of the plan, as few as its weights.
    by = plan.join(by, "source", "left").withColumn("whole", F.sum("tokens").over(Window.partitionBy(F.lit(0))))
    return (
        by.select(
            "source",
            "target_share",
            "max_repeats",
            "supply",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
            F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"),
            "short",
        )
    )
