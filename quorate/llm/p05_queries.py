"""Problem 5: flips that are no proper answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import pairs
from quorate.llm.registry import query, table


@query("p5_found")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each defective flip with its defect."""
    labelled = table(spark, sf, "documents").select("text", "lang"), "text", "lang"
    return pairs.defects(table(spark, sf, "flips"), "flip_id", "original_text", "flipped_text", labelled).distinct()


@query("p5_counts")
def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per model."""
    models = table(spark, sf, "flips").select("flip_id", "model_name")
    return p5_found(spark, sf).join(models, "flip_id").groupBy("model_name", "defect").agg(F.count("*").alias("n_flips"))
