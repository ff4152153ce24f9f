"""Problem 8: token ids of the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.llm import bpe
from quorate.llm.registry import query, table


@query("p8_ids")
def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf, "documents"), "doc_id", "text")
