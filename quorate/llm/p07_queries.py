"""Problem 7: texts in other characters than they seem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import lookalike
from quorate.llm.registry import query, table


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "comments").select(F.lit("comments").alias("table_name"), F.col("id").alias("record_key"), F.col("body").alias("text"))
    f = table(spark, sf, "four_cell_cohort").select(F.lit("four_cell_cohort").alias("table_name"), F.col("message_id").alias("record_key"), F.col("mirror_text").alias("text"))
    return c.unionByName(f)


@query("p7_found")
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose text is not in its plain form."""
    d = lookalike.unify(_texts(spark, sf), "text")
    return d.where("plain_text != text").select("table_name", "record_key").distinct()


@query("p7_texts")
def p7_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in one consistent form."""
    return lookalike.unify(_texts(spark, sf), "text").select("table_name", "record_key", "plain_text")
