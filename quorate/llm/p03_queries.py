"""Problem 3: test posts that are also in training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import overlap
from quorate.llm.registry import query, table


def _split(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, "split_ids").select(F.explode(f"{name}_post_ids").alias("key"))


@query("p3_found")
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the same or nearly the same text across the splits."""
    return overlap.cross_split(table(spark, sf, "four_cell_cohort"), "message_id", "original_text", _split(spark, sf, "train"), _split(spark, sf, "test"))


def _overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf, "four_cell_cohort"), "message_id", "original_text", _split(spark, sf, "train"), _split(spark, sf, "test"))


@query("p3_posts")
def p3_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Each post with a counterpart in the other split, its class of equal texts and its number of counterparts."""
    return _overlaps(spark, sf).withColumnRenamed("key", "message_id")


@query("p3_counts")
def p3_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts with a counterpart in the other split, per split and source (id prefix)."""
    return _overlaps(spark, sf).groupBy("split", F.substring_index("key", "_", 1).alias("source")).agg(F.count("*").alias("n_posts"))
