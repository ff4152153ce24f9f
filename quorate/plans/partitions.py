"""Summaries by party, condition, phase, platform and stance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import folded, stripped, usable
from quorate.operators import aggregate
from quorate.plans.common import DECISIONS, SPACE, decisions, table
from quorate.plans.registry import query

def removed() -> Column:
    return F.col("decision") == "remove"


@query("decisions_by_party", f"WITH {DECISIONS}, n AS (SELECT party_group, condition, decision, count(*) AS n FROM d GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY party_group, condition), 4) AS proportion FROM n")
def decisions_by_party(spark: SparkSession, sf: str) -> DataFrame:
    n = decisions(spark, sf).groupBy("party_group", "condition", "decision").agg(F.count("*").alias("n"))
    return aggregate.with_proportion(n, ["party_group", "condition"])


@query("removal_rates", f"WITH {DECISIONS}, x AS (SELECT party_group, lower(trim(sample_toxicity_type, {SPACE})) AS toxicity, (decision = 'remove')::INT AS r FROM d) SELECT party_group, toxicity, count(*) AS n, sum(r) AS n_hit, round(avg(r), 6) AS rate, round(1.96 * stddev_samp(r) / sqrt(count(r)), 6) AS half_width FROM x GROUP BY ALL")
def removal_rates(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).withColumn("toxicity", folded("sample_toxicity_type"))
    return aggregate.rate(d, ["party_group", "toxicity"], removed())


@query("decisions_by_platform", f"WITH {DECISIONS}, x AS (SELECT split_part(message_id, '_', 1) AS platform, decision FROM d) SELECT platform, count(*) FILTER (WHERE decision = 'keep') AS n_keep, count(*) FILTER (WHERE decision = 'remove') AS n_remove, count(*) AS n_total FROM x GROUP BY 1")
def decisions_by_platform(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).withColumn("platform", F.substring_index("message_id", "_", 1))
    return aggregate.crosstab(d, "platform", "decision", ["keep", "remove"])


@query("removal_cube", f"WITH {DECISIONS}, x AS (SELECT party_group, condition, (decision = 'remove')::INT AS removed FROM d WHERE trim(party_group) != '' AND trim(condition) != '') SELECT CASE WHEN grouping(party_group) = 1 THEN 'all' ELSE party_group END AS party_group, CASE WHEN grouping(condition) = 1 THEN 'all' ELSE condition END AS condition, count(*) AS n, round(avg(removed), 6) AS mean_removed FROM x GROUP BY CUBE (x.party_group, x.condition)")
def removal_cube(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).withColumn("removed", removed().cast("int"))
    return aggregate.cube_means(d, ["party_group", "condition"], ["removed"])


@query("decision_grouping_sets", f"WITH {DECISIONS} SELECT party_group, condition, TRY_CAST(phase AS DOUBLE)::INT AS phase, decision, count(*) AS n, round(avg(length(original_text)), 6) AS mean_chars FROM d GROUP BY GROUPING SETS ((party_group, condition, TRY_CAST(phase AS DOUBLE)::INT, decision), (party_group, condition, decision), (party_group, decision), (condition, decision), (decision))")
def decision_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    d = decisions(spark, sf).withColumn("phase", stripped("phase").try_cast("double").cast("int"))
    party, condition, phase, decision = (F.col(c) for c in ("party_group", "condition", "phase", "decision"))
    sets = [[party, condition, phase, decision], [party, condition, decision], [party, decision], [condition, decision], [decision]]
    return d.groupingSets(sets, party, condition, phase, decision).agg(F.count("*").alias("n"), F.round(F.avg(F.length("original_text")), 6).alias("mean_chars"))


@query("rating_summary", f"SELECT condition, count(r) AS n, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(stddev_samp(r), 6) AS sd, round(quantile_cont(r, 0.75), 6) AS p75 FROM (SELECT condition, TRY_CAST(trim(phase1_pair_influence_rating, {SPACE}) AS DOUBLE) AS r FROM trials WHERE trial_type = 'survey-html-form') WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1")
def rating_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = stripped("phase1_pair_influence_rating").try_cast("double")
    d = table(spark, sf, "trials").where("trial_type = 'survey-html-form'").select("condition", r.alias("r")).where("r IS NOT NULL AND NOT isnan(r)")
    return aggregate.summary(d, ["condition"], "r")


@query("rating_histogram", f"WITH x AS (SELECT condition, TRY_CAST(trim(phase1_pair_influence_rating, {SPACE}) AS DOUBLE) AS r FROM trials WHERE trial_type = 'survey-html-form') SELECT coalesce(condition, '') AS condition, " + ", ".join(f"count(*) FILTER (WHERE r = {i}) AS n_{i}" for i in range(1, 8)) + " FROM x GROUP BY 1")
def rating_histogram(spark: SparkSession, sf: str) -> DataFrame:
    r = stripped("phase1_pair_influence_rating").try_cast("double")
    d = table(spark, sf, "trials").where("trial_type = 'survey-html-form'").select(F.coalesce("condition", F.lit("")).alias("condition"), r.alias("r"))
    return d.groupBy("condition").agg(*[F.count_if(F.col("r") == i).alias(f"n_{i}") for i in range(1, 8)])


@query("stance_by_cell", f"WITH g AS (SELECT * FROM (VALUES ('left'), ('right')) s(stance), (VALUES ('unanimous_keep'), ('majority_keep'), ('majority_remove'), ('unanimous_remove')) c(cell)), n AS (SELECT lower(trim(sampled_stance, {SPACE})) AS stance, cell, count(*) AS n FROM four_cell_cohort GROUP BY ALL) SELECT g.stance, g.cell, coalesce(n.n, 0) AS n FROM g LEFT JOIN n USING (stance, cell)")
def stance_by_cell(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "four_cell_cohort").groupBy(folded("sampled_stance").alias("stance"), "cell").agg(F.count("*").alias("n"))
    return aggregate.complete(n, {"stance": ["left", "right"], "cell": ["unanimous_keep", "majority_keep", "majority_remove", "unanimous_remove"]})


@query("attrition", f"WITH u AS (SELECT condition, count(DISTINCT participant_id) AS n_assigned, count(DISTINCT CASE WHEN trial_type = 'survey-html-form' THEN participant_id END) AS n_found FROM trials WHERE condition IS NOT NULL GROUP BY 1) SELECT condition, n_assigned, n_found, n_assigned - n_found AS n_missing, round((n_assigned - n_found) / n_assigned, 4) AS rate FROM u")
def attrition(spark: SparkSession, sf: str) -> DataFrame:
    """Participants of each condition, and those who reached the final form."""
    found = F.when(F.col("trial_type") == "survey-html-form", F.col("participant_id"))
    u = table(spark, sf, "trials").where("condition IS NOT NULL").groupBy("condition").agg(F.count_distinct("participant_id").alias("n_assigned"), F.count_distinct(found).alias("n_found"))
    missing = F.col("n_assigned") - F.col("n_found")
    return u.withColumn("n_missing", missing).withColumn("rate", F.when(F.col("n_assigned") > 0, F.round(missing / F.col("n_assigned"), 4)))


@query("category_distribution", f"WITH n AS (SELECT CASE WHEN lower(trim(sample_toxicity_type, {SPACE})) NOT IN ('', 'nan') THEN lower(trim(sample_toxicity_type, {SPACE})) ELSE '<NA>' END AS category, count(*) AS n FROM four_cell_cohort GROUP BY 1) SELECT category, n, round(n / sum(n) OVER (), 4) AS proportion FROM n")
def category_distribution(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(usable("sample_toxicity_type"), folded("sample_toxicity_type")).otherwise("<NA>")
    n = table(spark, sf, "four_cell_cohort").groupBy(c.alias("category")).agg(F.count("*").alias("n"))
    return aggregate.with_proportion(n.withColumn("g", F.lit(0)), ["g"]).drop("g")
