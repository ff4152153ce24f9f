"""Problem 6: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import folded, usable
from quorate.llm import abuse
from quorate.llm.lookalike import Rewriter, frequencies
from quorate.llm.registry import query, table


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """table_name, record_key, source and the scores of every text."""
    comments = table(spark, sf, "comments")
    c = comments.select(F.lit("comments").alias("table_name"), F.col("id").alias("record_key"), F.when(usable("subreddit"), folded("subreddit")).alias("source"), F.col("body").alias("text"))
    f = table(spark, sf, "flips").select(F.lit("flips").alias("table_name"), F.col("post_primary_key").alias("record_key"), F.substring_index("post_primary_key", "_", 1).alias("source"), F.col("original_text").alias("text"))
    texts = c.unionByName(f)
    counts = frequencies(texts, "text")
    labels = table(spark, sf, "toxicity_labels").withColumnRenamed("comment_id", "id")
    sample, classes, weight = abuse.labelled_sample(labels, comments.select("id", "body"), "id", "body")
    model = abuse.fit(sample, classes, Rewriter(counts), weight)
    return abuse.score(texts, "text", model, counts)


@query("p6_found")
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records with abusive, hateful or sexual content."""
    return _scored(spark, sf).where(F.col("p_bad") >= abuse.THRESHOLD).select("table_name", "record_key").distinct()


@query("p6_scores")
def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores of every text."""
    return _scored(spark, sf)


@query("p6_rates")
def p6_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates per subreddit and per post source."""
    return abuse.rates(_scored(spark, sf), ["table_name", "source"])
