"""Scores, predictions, embeddings and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import vectors
from quorate.operators import evaluate, windows
from quorate.plans.common import table
from quorate.plans.registry import query

_SCORED = """WITH s AS (SELECT comment_id, max(prob_toxic) AS p FROM toxicity_scores WHERE was_successfully_labeled AND prob_toxic BETWEEN 0 AND 1 AND NOT isnan(prob_toxic) GROUP BY 1),
 g AS (SELECT comment_id, max(is_abusive) AS gold FROM toxicity_labels WHERE is_abusive IS NOT NULL GROUP BY 1),
 x AS (SELECT comment_id, gold, p, (p >= 0.7)::INT AS predicted FROM s JOIN g USING (comment_id))
"""
#: Thresholds of the sweep, as doubles that both engines make alike.
THRESHOLDS = [0.05 + i * 0.01 for i in range(91)]


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled comments with a valid score; repeated ones with their highest."""
    p = F.col("prob_toxic")
    s = table(spark, sf, "toxicity_scores").where(F.col("was_successfully_labeled") & p.between(0, 1) & ~F.isnan(p)).groupBy("comment_id").agg(F.max(p).alias("p"))
    g = table(spark, sf, "toxicity_labels").where("is_abusive IS NOT NULL").groupBy("comment_id").agg(F.max("is_abusive").alias("gold"))
    return s.join(g, "comment_id").withColumn("predicted", (F.col("p") >= 0.7).cast("int"))


@query("confusion", _SCORED + ", n AS (SELECT count(*) FILTER (WHERE gold = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE gold != 1 AND predicted != 1) AS tn, count(*) FILTER (WHERE gold != 1 AND predicted = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND predicted != 1) AS fn FROM x) SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM n")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(scored(spark, sf), [], "gold", "predicted")


@query("threshold_sweep", _SCORED + ", t AS (SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(91) r(i)), n AS (SELECT threshold, count(*) FILTER (WHERE gold = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE gold != 1 AND p < threshold) AS tn, count(*) FILTER (WHERE gold != 1 AND p >= threshold) AS fp, count(*) FILTER (WHERE gold = 1 AND p < threshold) AS fn FROM x, t GROUP BY 1) SELECT *, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1 FROM n")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.sweep(scored(spark, sf), "gold", "p", THRESHOLDS)


@query("ranking", _SCORED + ", c AS (SELECT p, count(*) FILTER (WHERE gold = 1) AS a, count(*) FILTER (WHERE gold != 1) AS b FROM x GROUP BY 1), r AS (SELECT *, sum(a) OVER (ORDER BY p DESC) AS ca, sum(b) OVER (ORDER BY p DESC) AS cb FROM c) SELECT sum(a)::BIGINT AS n_pos, sum(b)::BIGINT AS n_neg, CASE WHEN sum(a) * sum(b) > 0 THEN round(sum(b * (ca - a / 2)) / (sum(a) * sum(b)), 6) END AS roc_auc, CASE WHEN sum(a) > 0 THEN round(sum(a * ca / (ca + cb)) / sum(a), 6) END AS average_precision FROM r")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking(scored(spark, sf), "gold", "p")


@query("calibration_bins", _SCORED + "SELECT ceil(p * 10)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_score, round(avg(gold), 6) AS share FROM x WHERE p > 0 AND p <= 1 GROUP BY 1")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.calibration(scored(spark, sf), "gold", "p")


@query("brier_ece", _SCORED + ", b AS (SELECT CASE WHEN p > 0 THEN ceil(p * 10)::INT END AS bin, count(*) AS n, sum(p) AS s, sum(gold) AS g, sum((p - gold) * (p - gold)) AS e FROM x GROUP BY 1) SELECT sum(n)::BIGINT AS n, round(sum(e) / sum(n), 6) AS brier, round(sum(CASE WHEN bin IS NOT NULL THEN abs(s - g) ELSE 0 END) / sum(n), 6) AS ece FROM b")
def brier_ece(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.brier_ece(scored(spark, sf), "gold", "p")


@query("latest_scores", "SELECT comment_id, arg_max(prob_toxic, (scored_at, coalesce(reason, ''), coalesce(prob_toxic, -1))) AS prob_toxic, max(scored_at) AS scored_at FROM toxicity_scores WHERE comment_id IS NOT NULL AND was_successfully_labeled AND prob_toxic BETWEEN 0 AND 1 GROUP BY 1")
def latest_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The last valid score of each comment."""
    s = table(spark, sf, "toxicity_scores").where("comment_id IS NOT NULL AND was_successfully_labeled AND prob_toxic BETWEEN 0 AND 1")
    order = F.struct("scored_at", F.coalesce("reason", F.lit("")), "prob_toxic")
    return s.groupBy("comment_id").agg(F.max_by("prob_toxic", order).alias("prob_toxic"), F.max("scored_at").alias("scored_at"))


@query("cluster_sizes", "SELECT cluster_id, count(*) AS n, count(DISTINCT category) AS n_categories FROM assignments_hdbscan WHERE cluster_id != -1 GROUP BY 1")
def cluster_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assignments_hdbscan").where("cluster_id != -1").groupBy("cluster_id").agg(F.count("*").alias("n"), F.count_distinct("category").alias("n_categories"))


@query("cluster_lift", "WITH c AS (SELECT cluster_id, count(*) AS n, count(*) FILTER (WHERE rationale IS NULL) AS n_error FROM assignments_hdbscan GROUP BY 1) SELECT cluster_id, n, n_error, round(n_error / n, 6) AS error_rate, CASE WHEN sum(n_error) OVER () > 0 THEN round((n_error / n) / (sum(n_error) OVER () / sum(n) OVER ()), 6) END AS lift FROM c")
def cluster_lift(spark: SparkSession, sf: str) -> DataFrame:
    """Share of records without rationale per cluster, over that of all."""
    return evaluate.lift(table(spark, sf, "assignments_hdbscan"), "cluster_id", F.col("rationale").isNull())


@query("best_examples", "WITH r AS (SELECT cluster_id, feature_id, row_number() OVER (PARTITION BY cluster_id ORDER BY length(coalesce(evidence_span, '')) DESC, length(coalesce(feature_value, '')) DESC, feature_id) AS rank FROM assignments_hdbscan WHERE cluster_id >= 0) SELECT cluster_id, feature_id, rank FROM r WHERE rank <= 3")
def best_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each cluster with the longest evidence, then the longest value."""
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id >= 0").select("cluster_id", "feature_id", F.length(F.coalesce("evidence_span", F.lit(""))).alias("e"), F.length(F.coalesce("feature_value", F.lit(""))).alias("v"))
    return windows.top_per_group(a, ["cluster_id"], [F.desc("e"), F.desc("v"), F.asc("feature_id")], 3).drop("e", "v")


@query("category_agreement", "WITH c AS (SELECT category AS a, cluster_id AS b, count(*)::DOUBLE AS n FROM assignments_hdbscan GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2) AS rc, sum(n) AS t FROM c), y AS (SELECT sum(s * (s - 1) / 2) AS ra FROM (SELECT sum(n) AS s FROM c GROUP BY a)), z AS (SELECT sum(s * (s - 1) / 2) AS rb FROM (SELECT sum(n) AS s FROM c GROUP BY b)) SELECT round((rc - ra * rb / (t * (t - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (t * (t - 1) / 2)), 6) AS adjusted_rand FROM x, y, z")
def category_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Adjusted Rand index of categories and clusters."""
    return evaluate.adjusted_rand(table(spark, sf, "assignments_hdbscan"), "category", "cluster_id")


@query("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vectors.norm("embedding"), 4).alias("norm"))


@query("vector_neighbours", "SELECT a.vec_id, b.vec_id AS other_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of each vector and the one with the next id."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", "other_id", F.round(vectors.cosine("embedding", "other"), 4).alias("cosine"))


@query("score_histogram", "SELECT least(20, floor((prob_toxic - 0.0) / 0.05)::INT + 1) AS bin, count(*) AS n FROM toxicity_scores WHERE prob_toxic BETWEEN 0 AND 1 AND NOT isnan(prob_toxic) GROUP BY 1")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "toxicity_scores").where("prob_toxic BETWEEN 0 AND 1 AND NOT isnan(prob_toxic)")
    return s.groupBy(vectors.closed_bin("prob_toxic", 0.0, 1.0, 20).alias("bin")).agg(F.count("*").alias("n"))


@query("score_effect", _SCORED + "SELECT count(*) FILTER (WHERE gold = 1) AS n1, count(*) FILTER (WHERE gold != 1) AS n0, CASE WHEN count(*) FILTER (WHERE gold = 1) > 1 THEN round((avg(p) FILTER (WHERE gold = 1) - avg(p) FILTER (WHERE gold != 1)) / sqrt(((count(*) FILTER (WHERE gold = 1) - 1) * var_samp(p) FILTER (WHERE gold = 1) + (count(*) FILTER (WHERE gold != 1) - 1) * var_samp(p) FILTER (WHERE gold != 1)) / (count(*) - 2)), 6) END AS effect_size FROM x")
def score_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Effect size of the score between abusive and other comments."""
    return evaluate.effect_size(scored(spark, sf), F.col("gold") == 1, "p")


@query("feature_lines", "SELECT feature_id, coalesce(feature_name, '') || ': ' || coalesce(feature_value, '') || '. ' || coalesce(rationale, '') AS line FROM assignments_hdbscan")
def feature_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The text of each feature that is embedded."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, sf, "assignments_hdbscan").select("feature_id", F.concat(part("feature_name"), F.lit(": "), part("feature_value"), F.lit(". "), part("rationale")).alias("line"))
