"""Problem 1: consensus of the participants' decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import folded, stripped, usable
from quorate.llm import consensus
from quorate.llm.registry import query, table
from quorate.staging import stage

#: Fixed value: marks of test accounts in ``prolific_id``.
TEST_ACCOUNT = "pid|manual-test|dev"


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "trials")
    decision = folded("decision")
    countable = (
        (F.col("trial_type") == "moderation-trial")
        & (folded("evaluation_mode") == "linked_fate")
        & decision.isin("keep", "remove")
        & usable("post_id")
        & ~F.coalesce(F.lower("prolific_id").rlike(TEST_ACCOUNT), F.lit(False))
    )
    rows = t.where(countable).select(stripped("post_id").alias("post"), "participant_id", decision.alias("decision"), "trial_row_id")
    return stage(consensus.votes_of(rows, "post", "participant_id", F.col("decision") == "remove", ["trial_row_id"]), "p1-votes")


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Unreliable participants, and posts that the others would remove."""
    votes = _votes(spark, sf)
    _, annotators = consensus.discover(votes)
    annotators = stage(annotators, "p1-annotators")
    posts = consensus.reliable_majority(votes, annotators, 0.4, 3, 2 / 3)
    bad = annotators.where("informedness < 0.4").select(F.lit("annotator").alias("kind"), F.col("annotator").alias("item"))
    return bad.unionByName(posts.select(F.lit("post").alias("kind"), "item"))


@query("p1_labels")
def p1_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One keep/remove label and an agreement measure per post."""
    items, _ = consensus.discover(_votes(spark, sf))
    return items.select(F.col("item").alias("post_id"), F.when(F.col("label") == 1, "remove").otherwise("keep").alias("decision"), "truth", "n", "share", "agreement")


@query("p1_annotators")
def p1_annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Weight and reliability of each participant."""
    _, annotators = consensus.discover(_votes(spark, sf))
    return annotators.withColumnRenamed("annotator", "participant_id")
