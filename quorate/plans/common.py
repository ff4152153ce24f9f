"""Pieces that the queries and their SQL share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import folded, stripped, usable

SPACE = r"E' \t\n\r\x0b\x0c'"

#: SQL of the countable decisions as table d.
DECISIONS = rf"""
d AS (
  SELECT trial_row_id, trim(post_id, {SPACE}) AS message_id, original_text, mirror_text,
         lower(trim(decision, {SPACE})) AS decision, participant_id, party_group, condition, phase,
         sample_toxicity_type, sampled_stance
  FROM trials
  WHERE trial_type = 'moderation-trial'
    AND lower(trim(evaluation_mode, {SPACE})) = 'linked_fate'
    AND lower(trim(decision, {SPACE})) IN ('keep', 'remove')
    AND coalesce(lower(trim(post_id, {SPACE})) NOT IN ('', 'nan'), false))
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Countable trials with cleaned post and decision."""
    t = table(spark, sf, "trials")
    keep = (F.col("trial_type") == "moderation-trial") & (folded("evaluation_mode") == "linked_fate") & folded("decision").isin("keep", "remove") & usable("post_id")
    return t.where(keep).select("trial_row_id", stripped("post_id").alias("message_id"), "original_text", "mirror_text", folded("decision").alias("decision"), "participant_id", "party_group", "condition", "phase", "sample_toxicity_type", "sampled_stance")
