"""Samples with given category proportions.

Quotas are allotted by largest remainder under minimum floors and availability
caps; the records with the smallest random keys of each category are taken.
Nothing is ordered within a whole category: see :mod:`quorate.llm.ranks`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.functions.keys import folded, usable
from quorate.llm.ranks import random_key, running_total

TARGET_SCHEMA = "category string, target_share double, min_rows long, available long, wanted double, floor_rows long, quota long, missing long"


def allot(size: int, targets: Sequence[tuple[str, float, int, int]]) -> list[tuple[str, int]]:
    """Integer quotas for (category, share, floor, available), in the given order.

    The sample's ``size`` is divided by share; whole parts first, then one each
    by largest remainder (ties in the given order). A category gets at least its
    floor and at most what is available. What a cap leaves over goes to the
    others by share, until all is allotted or nothing is available. Floors may
    raise the sum above ``size``.
    """
    quota = {c: min(max(0, floor), have) for c, _, floor, have in targets}
    fixed: set[str] = set()
    while True:
        free = [t for t in targets if t[0] not in fixed]
        rest = size - sum(quota[c] for c in fixed)
        weight = sum(max(0.0, t[1]) for t in free)
        if rest <= 0 or weight <= 0:
            break
        exact = {c: max(0.0, share) / weight * rest for c, share, _, _ in free}
        bound = [(c, low, have) for c, _, low, have in free if exact[c] >= have or exact[c] < min(low, have)]
        over = sum(exact[c] - have for c, _, have in bound if exact[c] >= have)
        under = sum(min(low, have) - exact[c] for c, low, have in bound if exact[c] < have)
        # Fix the caps if they leave more over than the floors take, else the floors.
        capped = over >= under
        chosen = [(c, have if exact[c] >= have else min(low, have)) for c, low, have in bound if (exact[c] >= have) == capped]
        if chosen:
            for c, n in chosen:
                quota[c] = n
                fixed.add(c)
            continue
        whole = {c: math.floor(exact[c]) for c in exact}
        left = rest - sum(whole.values())
        order = sorted(range(len(free)), key=lambda i: (-(exact[free[i][0]] - whole[free[i][0]]), i))
        for i in order:
            c, _, _, have = free[i]
            if left > 0 and whole[c] < have:
                whole[c] += 1
                left -= 1
        quota |= whole
        break
    return [(c, quota[c]) for c, *_ in targets]


def categorized(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Distinct (key, category); several fields are joined by ``|``.

    The category is null unless all fields are usable. Rows without key drop out.
    """
    parts = [folded(df[f]) for f in fields]
    known = usable(df[fields[0]])
    for f in fields[1:]:
        known = known & usable(df[f])
    category = F.when(known, F.concat_ws("|", *parts))
    return df.where(df[key].isNotNull()).select(df[key].cast("string").alias("key"), category.alias("category")).distinct()


def plan(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Quota and shortfall of each target (category, target_share, min_rows, sample_fraction).

    ``records`` comes from :func:`categorized`. N is the number of distinct keys;
    the sample has floor(sample_fraction x N) rows. ``wanted`` is the larger of
    min_rows and target_share x that size; ``missing`` is by how many records
    the category falls short of it, rounded up. Repeated targets of one category
    are an error; null shares and floors count as 0, a null fraction as 1. An
    empty table gives quotas of 0.
    """
    spark = records.sparkSession
    # The targets are a parameter table of a few rows; the counts below are only of their categories.
    wanted = [r.asDict() for r in targets.select(folded("category").alias("category"), "target_share", "min_rows", "sample_fraction").collect()]
    names = [r["category"] for r in wanted]
    if len(set(names)) < len(names) or None in names:
        raise ValueError("each target needs a category of its own")
    keys = records.groupBy("key").agg(F.collect_set(F.when(F.col("category").isin(names), F.col("category"))).alias("c"))
    counts = keys.agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("c", c)).alias(f"c{i}") for i, c in enumerate(names)]).first()
    n = counts["n"]
    fraction = next((r["sample_fraction"] for r in wanted if r["sample_fraction"] is not None), 1.0)
    size = math.floor(fraction * n)
    have = {c: counts[f"c{i}"] for i, c in enumerate(names)}
    share = {r["category"]: r["target_share"] or 0.0 for r in wanted}
    floor = {r["category"]: int(r["min_rows"] or 0) for r in wanted}
    quota = dict(allot(size, [(c, share[c], floor[c], have[c]) for c in names]))
    rows = []
    for c in names:
        need = max(float(floor[c]), share[c] * size)
        rows.append((c, share[c], floor[c], have[c], need, min(floor[c], have[c]), quota[c], max(0, math.ceil(need - have[c])) if have[c] < need else 0))
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def draw(records: DataFrame, planned: DataFrame, seed: int = 42) -> DataFrame:
    """``key`` and ``category`` of the sample: per category the quota's smallest random keys.

    A key with several categories may be drawn once in each.
    """
    quotas = planned.where("quota > 0").select("category", "quota")
    rows = records.join(F.broadcast(quotas.select("category")), "category", "left_semi")  # as few rows as targets
    keyed = rows.withColumn("__k", random_key(seed, F.col("key"))).withColumn("__one", F.lit(1))
    placed = running_total(keyed, "category", "__k", "__one", "__rank", ["key"])
    return placed.join(F.broadcast(quotas), "category").where("__rank < quota").select("key", "category")


