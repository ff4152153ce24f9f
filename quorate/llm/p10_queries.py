"""Problem 10: documents decoded with a wrong encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.llm import garbled
from quorate.llm.registry import query, table


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled documents, restorable or not."""
    return garbled.find(table(spark, sf, "documents").select("doc_id", "text"), "text").where("garbled").select("doc_id").distinct()


@query("p10_restored")
def p10_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Garbled documents with the restored text, null where that is lost."""
    return garbled.find(table(spark, sf, "documents").select("doc_id", "text"), "text").where("garbled").select("doc_id", "restored")
