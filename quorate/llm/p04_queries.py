"""Problem 4: clusters of records that make the same claim."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import clusters
from quorate.llm.registry import query, table


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.cluster(table(spark, sf, "assignments_hdbscan").select("feature_id", "feature_value", "rationale"), "feature_id", "feature_value", "rationale")


@query("p4_found")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each clustered record with the smallest id of its cluster."""
    return _clustered(spark, sf).select("feature_id", "cluster_key").distinct()


@query("p4_clusters")
def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    d = clusters.typical(_clustered(spark, sf))
    return d.select("cluster_key", "size", F.array_join("members", ",").alias("typical"))
