"""Problem 2: samples with the shares of ``sample_targets``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.llm import quota
from quorate.llm.registry import query, table

#: The key of each table that is sampled.
KEYS = {"four_cell_cohort": "message_id", "mirrorview_comments": "comment_id"}

SQL_HAVE = r"""
WITH t AS (SELECT *, lower(trim(category, E' \t\n\r\x0b\x0c')) AS c FROM sample_targets),
a AS (SELECT message_id AS k, lower(trim(sample_toxicity_type, E' \t\n\r\x0b\x0c')) AS x, lower(trim(sampled_stance, E' \t\n\r\x0b\x0c')) AS y FROM four_cell_cohort WHERE message_id IS NOT NULL),
b AS (SELECT comment_id AS k, lower(trim(subreddit, E' \t\n\r\x0b\x0c')) AS x FROM mirrorview_comments WHERE comment_id IS NOT NULL),
r AS (SELECT 'sample_toxicity_type' AS f, k, x AS c FROM a WHERE x NOT IN ('', 'nan')
      UNION ALL SELECT 'sampled_stance', k, y FROM a WHERE y NOT IN ('', 'nan')
      UNION ALL SELECT 'sample_toxicity_type|sampled_stance', k, x || '|' || y FROM a WHERE x NOT IN ('', 'nan') AND y NOT IN ('', 'nan')
      UNION ALL SELECT 'subreddit', k, x FROM b WHERE x NOT IN ('', 'nan')),
n AS (SELECT 'four_cell_cohort' AS table_name, count(DISTINCT k) AS n FROM a UNION ALL SELECT 'mirrorview_comments', count(DISTINCT k) FROM b),
h AS (SELECT t.sample_name, t.category, t.min_rows, t.target_share, t.sample_fraction, n.n, count(DISTINCT r.k) AS available
      FROM t JOIN n USING (table_name) LEFT JOIN r ON r.f = t.field_name AND r.c = t.c
      GROUP BY ALL),
s AS (SELECT *, greatest(min_rows::double, target_share * floor(sample_fraction * n)) AS wanted FROM h)
"""


def _samples(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame, DataFrame]]:
    """Of each sample its name, its records and its plan."""
    targets = table(spark, sf, "sample_targets")
    found = []
    for r in targets.select("sample_name", "table_name", "field_name").distinct().orderBy("sample_name").collect():  # a fixed parameter table
        records = quota.categorized(table(spark, sf, r["table_name"]), KEYS[r["table_name"]], r["field_name"].split("|"))
        found.append((r["sample_name"], records, quota.plan(records, targets.where(F.col("sample_name") == r["sample_name"]))))
    return found


def _named(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("sample_name"), "*") for name, df in parts])


@query("p2_found", SQL_HAVE + "SELECT DISTINCT sample_name, category FROM s WHERE available < wanted")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets for which the records do not suffice."""
    return _named([(name, p) for name, _, p in _samples(spark, sf)]).where("available < wanted").select("sample_name", "category").distinct()


@query("p2_report", SQL_HAVE + "SELECT sample_name, category, available, wanted FROM s")
def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Available and wanted records of every target."""
    return _named([(name, p) for name, _, p in _samples(spark, sf)]).select("sample_name", "category", "available", "wanted")


@query("p2_quotas")
def p2_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """Quota, floor and shortfall of every target."""
    return _named([(name, p) for name, _, p in _samples(spark, sf)])


@query("p2_sample")
def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The records of every sample."""
    return _named([(name, quota.draw(records, p)) for name, records, p in _samples(spark, sf)])
