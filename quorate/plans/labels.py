"""Label queries: keep/remove decisions to labels of posts, and checks of their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import stripped, usable
from quorate.operators import aggregate, labels, validate, windows
from quorate.plans.common import DECISIONS, SPACE, decisions, table
from quorate.plans.registry import query

TEXTS = ["original_text", "mirror_text"]
COUNTS = f"""
WITH {DECISIONS}, c AS (
  SELECT message_id, max(original_text) AS original_text, max(mirror_text) AS mirror_text, count(*) AS n_raters,
         count(*) FILTER (WHERE decision = 'keep') AS keep_count, count(*) FILTER (WHERE decision = 'remove') AS remove_count
  FROM d GROUP BY message_id)
"""


@query("modal_labels", COUNTS + "SELECT message_id, original_text, mirror_text, CASE WHEN keep_count > remove_count THEN 'keep' ELSE 'remove' END AS decision, CASE WHEN keep_count > remove_count THEN 0 ELSE 1 END AS keep_remove_label FROM c")
def modal_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.modal(decisions(spark, sf), "message_id", TEXTS)


@query("unanimous_labels", COUNTS + "SELECT message_id, original_text, mirror_text, CASE WHEN keep_count > 0 THEN 'keep' ELSE 'remove' END AS decision, CASE WHEN keep_count > 0 THEN 0 ELSE 1 END AS keep_remove_label, n_raters FROM c WHERE n_raters >= 3 AND (keep_count = 0 OR remove_count = 0)")
def unanimous_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.unanimous(decisions(spark, sf), "message_id", TEXTS)


@query(
    "agreement_cells",
    COUNTS
    + """SELECT *, (keep_count = 0 OR remove_count = 0) AS is_unanimous,
    CASE WHEN keep_count = 0 OR remove_count = 0 THEN 'unanimous' ELSE 'majority' END || CASE WHEN keep_count > remove_count THEN '_keep' ELSE '_remove' END AS cell
    FROM c WHERE n_raters >= 3 AND keep_count != remove_count""",
)
def agreement_cells(spark: SparkSession, sf: str) -> DataFrame:
    return labels.cells(decisions(spark, sf), "message_id", TEXTS)


@query("rater_counts", COUNTS + "SELECT * FROM c")
def rater_counts(spark: SparkSession, sf: str) -> DataFrame:
    return labels.rater_counts(decisions(spark, sf), "message_id", TEXTS)


@query("class_balance", COUNTS + ", m AS (SELECT CASE WHEN keep_count > remove_count THEN 'keep' ELSE 'remove' END AS decision FROM c), n AS (SELECT decision, count(*) AS n FROM m GROUP BY 1) SELECT decision, n, round(n / sum(n) OVER (), 4) AS proportion FROM n")
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    n = modal_labels(spark, sf).groupBy("decision").agg(F.count("*").alias("n"))
    return aggregate.with_proportion(n.withColumn("g", F.lit(0)), ["g"]).drop("g")


@query("unstable_texts", f"WITH {DECISIONS} SELECT message_id, count(DISTINCT coalesce(original_text, '')) AS n_original_text, count(DISTINCT coalesce(mirror_text, '')) AS n_mirror_text FROM d GROUP BY 1 HAVING n_original_text > 1 OR n_mirror_text > 1")
def unstable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Posts whose text is not the same in all their trials."""
    return validate.dependents(decisions(spark, sf), "message_id", TEXTS)


@query("dataset_overview", f"WITH {DECISIONS} SELECT count(*) AS n_rows, count(DISTINCT message_id) AS n_posts, round(count(*) / count(DISTINCT message_id), 6) AS rows_per_post, count(DISTINCT participant_id) AS n_participants, count(DISTINCT sha256(coalesce(original_text, '')) || '|' || sha256(coalesce(mirror_text, ''))) AS n_pairs FROM d")
def dataset_overview(spark: SparkSession, sf: str) -> DataFrame:
    pair = F.concat_ws("|", *[F.sha2(F.coalesce(t, F.lit("")), 256) for t in TEXTS])
    return decisions(spark, sf).agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("message_id").alias("n_posts"),
        F.round(F.count("*") / F.count_distinct("message_id"), 6).alias("rows_per_post"),
        F.count_distinct("participant_id").alias("n_participants"),
        F.count_distinct(pair).alias("n_pairs"),
    )


@query(
    "valid_files",
    """WITH b AS (SELECT DISTINCT source_file FROM trials WHERE regexp_matches(lower(coalesce(prolific_id, '')), 'pid|manual-test|dev'))
    SELECT source_file, count(*) AS n_rows, count(DISTINCT participant_id) AS n_participants FROM trials WHERE source_file IS NOT NULL AND source_file NOT IN (SELECT source_file FROM b WHERE source_file IS NOT NULL) GROUP BY 1""",
)
def valid_files(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads without any row of a test account: one such row drops the whole file."""
    t = table(spark, sf, "trials")
    bad = t.where(F.lower("prolific_id").rlike("pid|manual-test|dev")).select("source_file").distinct()
    return t.where(F.col("source_file").isNotNull()).join(bad, "source_file", "left_anti").groupBy("source_file").agg(F.count("*").alias("n_rows"), F.count_distinct("participant_id").alias("n_participants"))


@query("cohort_against_trials", COUNTS + "SELECT f.message_id, f.n_raters AS cohort_raters, c.n_raters AS trial_raters FROM four_cell_cohort f LEFT JOIN c USING (message_id) WHERE c.n_raters IS NULL OR c.n_raters != f.n_raters")
def cohort_against_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort posts whose number of raters the trials do not confirm."""
    now = rater_counts(spark, sf).select("message_id", F.col("n_raters").alias("trial_raters"))
    f = table(spark, sf, "four_cell_cohort").select("message_id", F.col("n_raters").cast("long").alias("cohort_raters"))
    return f.join(now, "message_id", "left").where("trial_raters IS NULL OR trial_raters != cohort_raters")


@query(
    "reflections",
    rf"""WITH r AS (SELECT trim(participant_id, {SPACE}) AS participant_id, trim(prolific_id, {SPACE}) AS prolific_id, phase1_pair_reflection_text, TRY_CAST(phase1_pair_influence_rating AS DOUBLE) AS rating, trial_row_id,
           row_number() OVER (PARTITION BY trim(participant_id, {SPACE}) ORDER BY trial_row_id) AS rn
         FROM trials WHERE trial_type = 'survey-html-form' AND coalesce(lower(trim(phase1_pair_reflection_text, {SPACE})) NOT IN ('', 'nan'), false) AND coalesce(lower(trim(participant_id, {SPACE})) NOT IN ('', 'nan'), false))
    SELECT participant_id, prolific_id, phase1_pair_reflection_text, rating FROM r WHERE rn = 1""",
)
def reflections(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable reflection of each participant; a rating that is no number is null."""
    t = table(spark, sf, "trials").where((F.col("trial_type") == "survey-html-form") & usable("phase1_pair_reflection_text") & usable("participant_id"))
    rating = stripped("phase1_pair_influence_rating").try_cast("double")
    r = t.select("trial_row_id", stripped("participant_id").alias("participant_id"), stripped("prolific_id").alias("prolific_id"), "phase1_pair_reflection_text", rating.alias("rating"))
    return windows.first_per_key(r, ["participant_id"], ["trial_row_id"]).drop("trial_row_id")


@query("usual_condition", "WITH c AS (SELECT participant_id, condition, count(*) AS n FROM trials WHERE condition IS NOT NULL GROUP BY ALL) SELECT participant_id, arg_min(condition, (-n, condition)) AS condition FROM c GROUP BY 1")
def usual_condition(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent condition of each participant, of equals the smallest."""
    return labels.smallest_mode(table(spark, sf, "trials").where("condition IS NOT NULL"), "participant_id", "condition")
