"""Thresholds, calibration, baselines, cluster flags and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import parse
from quorate.operators import evaluate, windows
from quorate.plans.common import table
from quorate.plans.models import _SCORED, THRESHOLDS, scored
from quorate.plans.registry import query

_MEASURES = "round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1"
_BALANCED = "round(((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) + (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END)) / 2, 6) AS balanced_accuracy"
_AT = "count(*) FILTER (WHERE gold = 1 AND p >= threshold) AS tp, count(*) FILTER (WHERE gold != 1 AND p < threshold) AS tn, count(*) FILTER (WHERE gold != 1 AND p >= threshold) AS fp, count(*) FILTER (WHERE gold = 1 AND p < threshold) AS fn"
_SWEEP = _SCORED + f", t AS (SELECT 0.05::DOUBLE + i * 0.01::DOUBLE AS threshold FROM range(91) r(i)), n AS (SELECT threshold, {_AT} FROM x, t GROUP BY 1), w AS (SELECT threshold, {_MEASURES}, {_BALANCED} FROM n)"


@query("threshold_policies", _SWEEP + """, a AS (SELECT 'max_f1' AS policy, * FROM w ORDER BY f1 DESC, threshold LIMIT 1), b AS (SELECT 'max_precision_at_recall' AS policy, * FROM w ORDER BY (recall >= 0.8) DESC, CASE WHEN recall >= 0.8 THEN precision ELSE recall END DESC, CASE WHEN recall >= 0.8 THEN recall ELSE precision END DESC, threshold LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b""")
def threshold_policies(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold that each policy picks, with its measures."""
    w = evaluate.balanced(evaluate.sweep(scored(spark, sf), "gold", "p", THRESHOLDS))
    return evaluate.by_policy(w, 0.8).select("policy", "threshold", "accuracy", "precision", "recall", "f1", "balanced_accuracy")


@query("best_per_measure", _SCORED + f", t AS (SELECT i * 0.1::DOUBLE AS threshold FROM range(1, 10) r(i)), n AS (SELECT threshold, {_AT} FROM x, t GROUP BY 1), w AS (SELECT threshold, {_MEASURES} FROM n) " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS measure, threshold, {m} AS value FROM w ORDER BY {m} DESC, threshold LIMIT 1)" for m in ("accuracy", "precision", "recall", "f1")))
def best_per_measure(spark: SparkSession, sf: str) -> DataFrame:
    """Of nine thresholds the best for each measure."""
    measures = ["accuracy", "precision", "recall", "f1"]
    w = evaluate.sweep(scored(spark, sf), "gold", "p", [i * 0.1 for i in range(1, 10)])
    long = w.unpivot("threshold", measures, "measure", "value")
    # Nine thresholds and four measures.
    return long.groupBy("measure").agg(F.max_by("threshold", F.struct("value", -F.col("threshold"))).alias("threshold"), F.max("value").alias("value"))


@query("measures_at_threshold", _SCORED + f", n AS (SELECT 0.7::DOUBLE AS threshold, count(*) FILTER (WHERE gold = 1 AND p >= 0.7) AS tp, count(*) FILTER (WHERE gold != 1 AND p < 0.7) AS tn, count(*) FILTER (WHERE gold != 1 AND p >= 0.7) AS fp, count(*) FILTER (WHERE gold = 1 AND p < 0.7) AS fn FROM x) SELECT threshold, tp, tn, fp, fn, {_MEASURES}, {_BALANCED} FROM n")
def measures_at_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """All measures at one threshold, the balanced accuracy among them."""
    return evaluate.balanced(evaluate.sweep(scored(spark, sf), "gold", "p", [0.7]))


_ANSWER = "CASE WHEN flip_id % 7 = 0 THEN 'unsure ' || decision WHEN flip_id % 5 = 0 THEN '' WHEN flip_id % 3 = 0 THEN ' \"' || upper(decision) || '.\" because' ELSE decision END"
_GENERATED = f"g AS (SELECT f.flip_id, f.model_name, c.decision AS gold, {_ANSWER} AS answer FROM (SELECT flip_id, model_name, post_primary_key FROM flips) f JOIN (SELECT message_id, CASE WHEN cell LIKE '%keep' THEN 'keep' ELSE 'remove' END AS decision FROM four_cell_cohort) c ON c.message_id = f.post_primary_key), p AS (SELECT *, CASE lower(trim(regexp_extract(trim(answer, E' \\t\\n\\r'), '^\\S+'), '.,:;!?\"''`')) WHEN 'keep' THEN 'keep' WHEN 'remove' THEN 'remove' ELSE '__invalid__' END AS predicted FROM g), l AS (SELECT *, (gold = 'remove')::INT AS y, CASE predicted WHEN 'keep' THEN 0 WHEN 'remove' THEN 1 ELSE 1 - (gold = 'remove')::INT END AS yhat FROM p)"


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in generations about cohort posts: right, shouted, empty or evasive, by the flip's number."""
    c = table(spark, sf, "four_cell_cohort").select(F.col("message_id").alias("post_primary_key"), F.when(F.col("cell").endswith("keep"), "keep").otherwise("remove").alias("gold"))
    f = table(spark, sf, "flips").select("flip_id", "model_name", "post_primary_key").join(c, "post_primary_key")
    i = F.col("flip_id")
    answer = F.when(i % 7 == 0, F.concat(F.lit("unsure "), "gold")).when(i % 5 == 0, "").when(i % 3 == 0, F.concat(F.lit(' "'), F.upper("gold"), F.lit('." because'))).otherwise(F.col("gold"))
    return f.select("flip_id", "model_name", "gold", answer.alias("answer"))


@query("parsed_generations", f"WITH {_GENERATED} SELECT predicted, count(*) AS n FROM l GROUP BY 1")
def parsed_generations(spark: SparkSession, sf: str) -> DataFrame:
    """Generations by what their first word decides."""
    return generations(spark, sf).groupBy(parse.decision("answer").alias("predicted")).agg(F.count("*").alias("n"))


@query("generation_measures", f"WITH {_GENERATED}, n AS (SELECT model_name, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn FROM l GROUP BY 1) SELECT *, {_MEASURES} FROM n")
def generation_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures per model; an invalid generation counts as wrong."""
    d = generations(spark, sf).withColumn("y", (F.col("gold") == "remove").cast("int")).withColumn("predicted", parse.decision("answer"))
    return evaluate.confusion(d, ["model_name"], "y", parse.effective_label("predicted", "y"))


@query("run_ranking", _SCORED + f", r AS (SELECT g.rater, x.gold, x.p FROM x JOIN (SELECT DISTINCT comment_id, coalesce(rater, 'unknown') AS rater FROM toxicity_labels) g USING (comment_id)), n AS (SELECT rater, count(*) FILTER (WHERE gold = 1 AND p >= 0.5) AS tp, count(*) FILTER (WHERE gold != 1 AND p < 0.5) AS tn, count(*) FILTER (WHERE gold != 1 AND p >= 0.5) AS fp, count(*) FILTER (WHERE gold = 1 AND p < 0.5) AS fn FROM r GROUP BY 1), m AS (SELECT rater, {_MEASURES} FROM n) SELECT rater, f1, recall, row_number() OVER (ORDER BY f1 DESC, recall DESC, rater) AS rank, round(max(f1) OVER () - f1, 6) AS behind FROM m")
def run_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Runs (here the raters' shares of the labels) ranked by f1, then recall, and how far each is behind the best."""
    g = table(spark, sf, "toxicity_labels").select("comment_id", F.coalesce("rater", F.lit("unknown")).alias("rater")).distinct()
    d = scored(spark, sf).join(g, "comment_id")
    m = evaluate.confusion(d, ["rater"], "gold", (F.col("p") >= 0.5).cast("int"))
    return evaluate.ranked_runs(m, "rater", ["f1", "recall"]).select("rater", "f1", "recall", "rank", "behind")


@query("trivial_baselines", "WITH c AS (SELECT message_id, (cell LIKE '%remove')::INT AS y, (('0x' || left(sha256('7:' || message_id), 8))::BIGINT / 4294967296.0::DOUBLE) AS u FROM four_cell_cohort), b AS (SELECT avg(y) AS prior FROM c), l AS (SELECT 'all_keep' AS baseline, y, 0 AS yhat FROM c UNION ALL SELECT 'all_remove', y, 1 FROM c UNION ALL SELECT 'by_prior', y, (u < prior)::INT FROM c, b), n AS (SELECT baseline, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn FROM l GROUP BY 1) SELECT *, " + _MEASURES + " FROM n")
def trivial_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of keeping all, removing all, and removing at random by the prior."""
    c = table(spark, sf, "four_cell_cohort").select("message_id", F.col("cell").endswith("remove").cast("int").alias("y"))
    return evaluate.baselines(c, "message_id", "y", 7)


_SPLITS = "s AS (SELECT cluster_id, (rationale IS NULL)::INT AS e, CASE WHEN ('0x' || left(sha256('3:' || feature_id), 8))::BIGINT / 4294967296.0::DOUBLE < 0.7 THEN 'train' ELSE 'test' END AS split FROM assignments_hdbscan WHERE cluster_id >= 0)"
_SIDES = _SPLITS + ", g AS (SELECT avg(e) FILTER (WHERE split = 'train') AS gt, avg(e) FILTER (WHERE split = 'test') AS ge FROM s), c AS (SELECT cluster_id, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test, avg(e) FILTER (WHERE split = 'train') AS rate_train, avg(e) FILTER (WHERE split = 'test') AS rate_test FROM s GROUP BY 1), f AS (SELECT *, rate_train / nullif(gt, 0) AS lift_train, rate_test / nullif(ge, 0) AS lift_test FROM c, g)"


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), "feature_id"), 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id >= 0").select("cluster_id", F.col("rationale").isNull().cast("int").alias("e"), F.when(u < 0.7, "train").otherwise("test").alias("split"))
    return evaluate.lift_by_split(a, "cluster_id", "e", "split")


@query("cluster_flags", f"WITH {_SIDES} SELECT cluster_id, n_train, n_test, round(lift_train, 6) AS lift_train, round(lift_test, 6) AS lift_test, CASE WHEN n_test < 5 THEN 'small_test' WHEN lift_train >= 1.25 AND lift_test >= 1.25 THEN CASE WHEN abs(rate_train - rate_test) <= 0.08 THEN 'high_lift_stable' ELSE 'high_lift_unstable' END WHEN lift_train <= 0.70 AND lift_test <= 0.70 THEN CASE WHEN abs(rate_train - rate_test) <= 0.08 THEN 'low_error_stable' ELSE 'low_error_unstable' END ELSE '' END AS flags FROM f")
def cluster_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters whose errors are frequent or rare in both splits, and those too small to tell."""
    return evaluate.flagged(_sides(spark, sf), least=5).select("cluster_id", "n_train", "n_test", F.round("lift_train", 6).alias("lift_train"), F.round("lift_test", 6).alias("lift_test"), "flags")


@query("cluster_sanity", f"WITH {_SIDES} SELECT count(*) AS n_clusters, count(*) FILTER (WHERE n_test >= 5) AS n_large, round(max(lift_test) FILTER (WHERE n_test >= 5), 6) AS max_lift, round(min(lift_test) FILTER (WHERE n_test >= 5), 6) AS min_lift FROM f")
def cluster_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """The extreme lifts among clusters with enough test records."""
    large = F.when(F.col("n_test") >= 5, F.col("lift_test"))
    return _sides(spark, sf).agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n_test") >= 5).alias("n_large"), F.round(F.max(large), 6).alias("max_lift"), F.round(F.min(large), 6).alias("min_lift"))


@query("error_labels", _SCORED + "SELECT comment_id, (gold = predicted)::INT AS is_correct, 1 - (gold = predicted)::INT AS is_error, CASE WHEN gold = 1 AND predicted = 1 THEN 'tp' WHEN gold = 1 THEN 'fn' WHEN predicted = 1 THEN 'fp' ELSE 'tn' END AS bucket FROM x")
def error_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every prediction as right or wrong, and its cell of the confusion matrix."""
    d = scored(spark, sf)
    right = (F.col("gold") == F.col("predicted")).cast("int")
    return d.select("comment_id", right.alias("is_correct"), (1 - right).alias("is_error"), evaluate.bucket("gold", "predicted").alias("bucket"))


@query("midpoint_accuracy", _SCORED + ", m AS (SELECT avg(p) FILTER (WHERE gold = 1) AS m1, avg(p) FILTER (WHERE gold != 1) AS m0 FROM x) SELECT count(*) AS n, round(avg(((CASE WHEN m1 >= m0 THEN p >= (m1 + m0) / 2 ELSE p < (m1 + m0) / 2 END)::INT = gold)::INT), 6) AS accuracy FROM x, m")
def midpoint_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the threshold halfway between the two groups' means, on whichever side the higher one is."""
    return evaluate.midpoint_accuracy(scored(spark, sf), "gold", "p")


@query("split_measures", _SCORED + f", z AS (SELECT *, CASE WHEN ('0x' || left(sha256('3:' || comment_id), 8))::BIGINT / 4294967296.0::DOUBLE < 0.7 THEN 'train' ELSE 'test' END AS split FROM x), n AS (SELECT split, count(*) FILTER (WHERE gold = 1 AND predicted = 1) AS tp, count(*) FILTER (WHERE gold != 1 AND predicted != 1) AS tn, count(*) FILTER (WHERE gold != 1 AND predicted = 1) AS fp, count(*) FILTER (WHERE gold = 1 AND predicted != 1) AS fn FROM z GROUP BY 1), m AS (SELECT split, {_MEASURES} FROM n) SELECT split, m.measure, value FROM m UNPIVOT (value FOR measure IN (accuracy, precision, recall, f1)) m")
def split_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of both splits, one row a measure."""
    u = F.conv(F.substring(F.sha2(F.concat(F.lit("3:"), "comment_id"), 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    d = scored(spark, sf).withColumn("split", F.when(u < 0.7, "train").otherwise("test"))
    return evaluate.confusion(d, ["split"], "gold", "predicted").unpivot("split", ["accuracy", "precision", "recall", "f1"], "measure", "value")


@query("calibrated_scores")
def calibrated_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Brier score and calibration error before and after sigmoid and isotonic calibration, fitted on one half, measured on the other."""
    from quorate.operators import learn

    u = F.pmod(F.xxhash64("comment_id"), F.lit(2))
    d = scored(spark, sf)
    fit, held = d.where(u == 0), d.where(u == 1)
    parts = []
    for name in ("none", "sigmoid", "isotonic"):
        c = held if name == "none" else learn.calibrated(fit, held, "gold", "p", name)
        parts.append(evaluate.brier_ece(c, "gold", "p").select(F.lit(name).alias("method"), "n", "brier", "ece"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("tiered_choice", "WITH f AS (SELECT post_primary_key, flip_id, model_name, length(flipped_text) >= 20 AS complete, lower(trim(sampled_stance)) IN ('left', 'right') AS stance, length(explanation) > 0 AS explained FROM flips), t AS (SELECT *, CASE WHEN coalesce(complete AND stance AND explained, false) THEN 1 WHEN coalesce(complete AND stance, false) THEN 2 WHEN coalesce(complete, false) THEN 3 ELSE 4 END AS tier FROM f) SELECT post_primary_key, arg_min(flip_id, (tier, sha256('5:' || flip_id))) AS flip_id, min(tier) AS tier FROM t GROUP BY 1")
def tiered_choice(spark: SparkSession, sf: str) -> DataFrame:
    """One flip of each post: of the best tier of criteria, at random within it."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    complete, stance, explained = F.length("flipped_text") >= 20, F.lower(F.trim("sampled_stance")).isin("left", "right"), F.length("explanation") > 0
    f = table(spark, sf, "flips").select("post_primary_key", "flip_id", parse.tier([ok(complete), ok(stance), ok(explained)]).alias("tier"), F.sha2(F.concat(F.lit("5:"), "flip_id"), 256).alias("h"))
    return windows.first_per_key(f, ["post_primary_key"], ["tier", "h"]).select("post_primary_key", "flip_id", "tier")
