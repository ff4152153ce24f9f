"""Reply trees: depth of a comment below its link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorate.staging import stage

#: Fixed value: no walk is longer than this.
MOST_HOPS = 20


def depth(df: DataFrame, key: str, parent: str, most: int = MOST_HOPS) -> DataFrame:
    """``key`` and ``depth``: the parents that are met among the rows, at most ``most``.

    Pointers are doubled: after step i a row knows its ancestor 2^i hops up, so
    ``most`` hops take about log2(most) joins. A missing parent ends the walk;
    in a cycle the walk ends at ``most``. Rows of one key must agree on the parent.
    """
    edges = df.select(F.col(key).alias("id"), F.col(parent).alias("up")).where("id IS NOT NULL").groupBy("id").agg(F.max("up").alias("up"))
    known = edges.select(F.col("id").alias("up"), F.lit(1).alias("there"))
    # A null pointer means that the walk has ended; hops counts the steps so far.
    walk = edges.join(known, "up", "left").select("id", F.when(F.col("there") == 1, F.col("up")).alias("up"), F.coalesce("there", F.lit(0)).alias("hops"))
    steps = 1
    while steps < most:
        above = walk.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        walk = walk.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
        # Each step reads the last one twice: written down, it is made once.
        walk = stage(walk, "replies")
        steps *= 2
    return walk.select(F.col("id").alias(key), F.least(F.lit(most), F.col("hops")).alias("depth"))
