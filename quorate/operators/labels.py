"""Labels of items from the decisions of their raters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_share(decision: str = "decision") -> tuple[Column, Column, Column]:
    keep, remove = F.count_if(F.col(decision) == "keep"), F.count_if(F.col(decision) == "remove")
    return keep.alias("keep_count"), remove.alias("remove_count"), F.count("*").alias("n_raters")


def rater_counts(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Raters, keep and remove decisions and the (greatest) texts per key."""
    keep, remove, n = keep_share()
    return df.groupBy(key).agg(*[F.max(t).alias(t) for t in texts], n, keep, remove)


def modal(df: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """The majority decision; a tie counts as remove."""
    kept = F.col("keep_count") > F.col("remove_count")
    c = rater_counts(df, key, texts)
    return c.select(key, *texts, F.when(kept, "keep").otherwise("remove").alias("decision"), F.when(kept, 0).otherwise(1).alias("keep_remove_label"))


def unanimous(df: DataFrame, key: str, texts: list[str], least: int = 3) -> DataFrame:
    """Items of ``least`` raters or more who all agree."""
    c = rater_counts(df, key, texts).where((F.col("n_raters") >= least) & ((F.col("keep_count") == 0) | (F.col("remove_count") == 0)))
    return c.select(key, *texts, F.when(F.col("keep_count") > 0, "keep").otherwise("remove").alias("decision"), F.when(F.col("keep_count") > 0, 0).otherwise(1).alias("keep_remove_label"), "n_raters")


def cells(df: DataFrame, key: str, texts: list[str], least: int = 3) -> DataFrame:
    """Items of ``least`` raters or more without a tie, by unanimity and majority."""
    c = rater_counts(df, key, texts).where((F.col("n_raters") >= least) & (F.col("keep_count") != F.col("remove_count")))
    all_agree = (F.col("keep_count") == 0) | (F.col("remove_count") == 0)
    side = F.when(F.col("keep_count") > F.col("remove_count"), "keep").otherwise("remove")
    return c.withColumn("is_unanimous", all_agree).withColumn("cell", F.concat_ws("_", F.when(all_agree, "unanimous").otherwise("majority"), side))


def smallest_mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value per key, of equals the smallest; null values count only if there are no others."""
    c = df.groupBy(key, value).agg(F.count("*").alias("__n"))
    rank = F.struct(F.col(value).isNotNull().cast("int"), "__n")
    top = c.groupBy(key).agg(F.max(rank).alias("__top"))
    return c.join(top, key).where(rank == F.col("__top")).groupBy(key).agg(F.min(value).alias(value))
