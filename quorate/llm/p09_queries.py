"""Problem 9: a mix of sources with target shares of the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quorate.llm import bpe, mixing
from quorate.llm.registry import query, table
from quorate.staging import stage


#: Weight schedules of the mix: short social posts early, written reasons late, the rest throughout.
#: Each integrates to its source's share.
SCHEDULES = {
    "reddit": ((0.0, 1.5), (1.0, 0.5)),
    "twitter": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)),
    "bluesky": ((0.0, 2.0), (0.5, 1.0), (1.0, 0.0)),
    "reflection": ((0.0, 0.5), (1.0, 1.5)),
    "rationale": ((0.0, 0.0), (0.25, 0.0), (1.0, 2.0)),
    "explanation": ((0.0, 0.0), (0.5, 1.0), (1.0, 1.0)),
}


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return bpe.count_tokens(d, "text", "n_tokens")


@query("p9_found")
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that cannot fill their share."""
    plan = mixing.budget(_sized(spark, sf), "source", "n_tokens", table(spark, sf, "source_weights"))
    return plan.where("short").select("source").distinct()


@query("p9_mix")
def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix, in training order."""
    sized = stage(_sized(spark, sf), "p9-sized")
    plan = mixing.budget(sized, "source", "n_tokens", table(spark, sf, "source_weights"))
    return mixing.mix(sized, "doc_id", "source", "n_tokens", plan, SCHEDULES)


@query("p9_report")
def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of the mix."""
    sized = stage(_sized(spark, sf), "p9-sized")
    plan = mixing.budget(sized, "source", "n_tokens", table(spark, sf, "source_weights"))
    return mixing.report(mixing.mix(sized, "doc_id", "source", "n_tokens", plan, SCHEDULES), plan)
