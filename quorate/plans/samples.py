"""Samples, splits, batches and events over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.operators import sampling, windows
from quorate.plans.common import table
from quorate.plans.registry import query

_H = "sha256('42:' || message_id)"


@query("hash_sample", f"SELECT message_id, cell FROM four_cell_cohort ORDER BY {_H}, message_id LIMIT 25")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of 25 posts that any engine can repeat."""
    return sampling.sample(table(spark, sf, "four_cell_cohort").select("message_id", "cell"), "message_id", 25)


@query("balanced_sample", f"WITH r AS (SELECT message_id, cell, row_number() OVER (PARTITION BY cell ORDER BY {_H}, message_id) AS r FROM four_cell_cohort) SELECT message_id, cell FROM r WHERE r <= 10")
def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.per_class(table(spark, sf, "four_cell_cohort").select("message_id", "cell"), "message_id", ["cell"], 10)


@query("share_sample", f"WITH r AS (SELECT message_id, cell, row_number() OVER (PARTITION BY cell ORDER BY {_H}, message_id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM four_cell_cohort) SELECT message_id, cell FROM r WHERE r <= ceil(n * 0.15)")
def share_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.share_per_class(table(spark, sf, "four_cell_cohort").select("message_id", "cell"), "message_id", ["cell"], 0.15)


@query("stratified_split", f"WITH r AS (SELECT message_id, cell, row_number() OVER (PARTITION BY cell ORDER BY {_H}, message_id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM four_cell_cohort) SELECT message_id, cell, CASE WHEN r <= floor(n * 0.7 + 1e-9) THEN 'train' WHEN r <= floor(n * (0.7 + 0.15) + 1e-9) THEN 'validation' ELSE 'test' END AS split FROM r")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split(table(spark, sf, "four_cell_cohort").select("message_id", "cell"), "message_id", ["cell"], [("train", 0.7), ("validation", 0.15), ("test", 0.15)])


@query("post_batches", "WITH r AS (SELECT cell, message_id, row_number() OVER (PARTITION BY cell ORDER BY message_id) - 1 AS i, count(*) OVER (PARTITION BY cell) AS n FROM four_cell_cohort) SELECT cell, message_id, floor(i / 10)::INT AS batch_id FROM r WHERE i < n - n % 10")
def post_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of each cell in whole batches of ten."""
    return windows.batches(table(spark, sf, "four_cell_cohort").select("cell", "message_id"), ["cell"], ["message_id"], 10, whole_only=True)


@query("split_membership", "WITH t AS (SELECT DISTINCT unnest(train_post_ids) AS id FROM split_ids), e AS (SELECT DISTINCT unnest(test_post_ids) AS id FROM split_ids) SELECT f.message_id, (t.id IS NOT NULL) AS in_train, (e.id IS NOT NULL) AS in_test FROM four_cell_cohort f LEFT JOIN t ON t.id = f.message_id LEFT JOIN e ON e.id = f.message_id")
def split_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Which splits list each cohort post."""
    s = table(spark, sf, "split_ids")
    listed = lambda c, flag: s.select(F.explode(c).alias("message_id")).where("message_id IS NOT NULL").distinct().withColumn(flag, F.lit(True))
    f = table(spark, sf, "four_cell_cohort").select("message_id")
    joined = f.join(listed("train_post_ids", "in_train"), "message_id", "left").join(listed("test_post_ids", "in_test"), "message_id", "left")
    return joined.select("message_id", F.coalesce("in_train", F.lit(False)).alias("in_train"), F.coalesce("in_test", F.lit(False)).alias("in_test"))


@query("vanished_split_ids", "WITH i AS (SELECT split_id, 'train' AS split, unnest(train_post_ids) AS id FROM split_ids UNION ALL SELECT split_id, 'test', unnest(test_post_ids) FROM split_ids) SELECT split_id, split, count(*) AS n_listed, count(DISTINCT id) AS n_distinct, count(*) FILTER (WHERE id IS NULL) AS n_null, count(DISTINCT id) FILTER (WHERE id NOT IN (SELECT message_id FROM four_cell_cohort)) AS n_unknown FROM i GROUP BY ALL")
def vanished_split_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Null, repeated and unknown ids of the splits."""
    s = table(spark, sf, "split_ids")
    ids = s.select("split_id", F.lit("train").alias("split"), F.explode("train_post_ids").alias("id")).unionByName(s.select("split_id", F.lit("test").alias("split"), F.explode("test_post_ids").alias("id")))
    known = table(spark, sf, "four_cell_cohort").select(F.col("message_id").alias("id"), F.lit(1).alias("known"))
    j = ids.join(known, "id", "left")
    unknown = F.when(F.col("id").isNotNull() & F.col("known").isNull(), F.col("id"))
    return j.groupBy("split_id", "split").agg(F.count("*").alias("n_listed"), F.count_distinct("id").alias("n_distinct"), F.count_if(F.col("id").isNull()).alias("n_null"), F.count_distinct(unknown).alias("n_unknown"))


@query("latest_flips", "SELECT post_primary_key, arg_max(flip_id, (generated_at, flip_id)) AS flip_id, count(*) AS n_tries FROM flips GROUP BY 1")
def latest_flips(spark: SparkSession, sf: str) -> DataFrame:
    """The last flip of each post."""
    return table(spark, sf, "flips").groupBy("post_primary_key").agg(F.max_by("flip_id", F.struct("generated_at", "flip_id")).alias("flip_id"), F.count("*").alias("n_tries"))


@query("flip_coverage", "WITH p AS (SELECT DISTINCT message_id FROM four_cell_cohort), f AS (SELECT DISTINCT post_primary_key AS message_id FROM flips) SELECT split_part(message_id, '_', 1) AS platform, count(*) AS n_posts, count(f.message_id) AS n_flipped FROM p LEFT JOIN f USING (message_id) GROUP BY 1")
def flip_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort posts with a flip, per platform."""
    f = table(spark, sf, "flips").select(F.col("post_primary_key").alias("message_id")).distinct().withColumn("there", F.lit(1))
    p = table(spark, sf, "four_cell_cohort").select("message_id").distinct()
    return p.join(f, "message_id", "left").groupBy(F.substring_index("message_id", "_", 1).alias("platform")).agg(F.count("*").alias("n_posts"), F.count("there").alias("n_flipped"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events per day and type."""
    e = table(spark, sf, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("event_props", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props(spark: SparkSession, sf: str) -> DataFrame:
    """A number out of the events' JSON."""
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
