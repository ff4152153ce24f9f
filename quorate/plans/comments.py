"""Comments: filters, reply trees, exports, months, repeated downloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions.keys import stripped
from quorate.operators import replies, windows
from quorate.plans.common import SPACE, table
from quorate.plans.registry import query

#: The subreddits of the study and the authors that do not count.
SUBREDDITS = ["Conservative", "Republican", "AskConservatives", "politics", "liberal", "democrats"]
NO_AUTHOR = ["", "[deleted]", "[removed]", "AutoModerator"]
NO_BODY = ["[deleted]", "[removed]"]
SHORTEST, LONGEST = 20, 300

_LISTED = ", ".join(f"'{s}'" for s in SUBREDDITS)
_ELIGIBLE = f"""coalesce(id != '', false) AND coalesce(link_id != '', false) AND subreddit IN ({_LISTED}) AND coalesce(trim(author, {SPACE}), '') NOT IN ('', '[deleted]', '[removed]', 'AutoModerator')
 AND coalesce(trim(body, {SPACE}), '') NOT IN ('[deleted]', '[removed]') AND length(trim(body, {SPACE})) BETWEEN {SHORTEST} AND {LONGEST}"""


def eligible(c: DataFrame) -> DataFrame:
    """Comments with an author and a body of the right length, in the study's subreddits."""
    body, author = stripped("body"), stripped("author")
    return c.where((F.col("id") != "") & (F.col("link_id") != "") & F.col("subreddit").isin(SUBREDDITS) & ~author.isin(NO_AUTHOR) & ~body.isin(NO_BODY) & F.length(body).between(SHORTEST, LONGEST))


@query("eligible_comments", f"SELECT subreddit, count(*) AS n_rows, count(DISTINCT id) AS n_comments FROM comments WHERE {_ELIGIBLE} GROUP BY 1")
def eligible_comments(spark: SparkSession, sf: str) -> DataFrame:
    return eligible(table(spark, sf, "comments")).groupBy("subreddit").agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_comments"))


@query("latest_comments", "SELECT id, arg_max(score, (retrieved_at, source_file, score)) AS score, max(retrieved_at) AS retrieved_at, count(*) AS n_downloads FROM comments WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def latest_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The last download of each comment that was downloaded more than once."""
    c = table(spark, sf, "comments").where("id IS NOT NULL")
    return c.groupBy("id").agg(F.max_by("score", F.struct("retrieved_at", "source_file", "score")).alias("score"), F.max("retrieved_at").alias("retrieved_at"), F.count("*").alias("n_downloads")).where("n_downloads > 1")


@query(
    "reply_depths",
    f"""WITH RECURSIVE e AS (SELECT id, max(substr(parent_id, 4)) AS up FROM comments WHERE id IS NOT NULL AND {_ELIGIBLE} GROUP BY 1),
    w(id, up, depth) AS (SELECT id, up, 0 FROM e UNION ALL SELECT w.id, e.up, w.depth + 1 FROM w JOIN e ON e.id = w.up WHERE w.depth < 20)
    SELECT id, max(depth) AS depth FROM w GROUP BY 1""",
)
def reply_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of each eligible comment below its link, over eligible parents."""
    c = eligible(table(spark, sf, "comments")).select("id", F.expr("substr(parent_id, 4)").alias("parent"))
    return replies.depth(c, "id", "parent")


@query("comment_exports", f"SELECT id AS comment_id, 't1_' || id AS comment_fullname, substr(link_id, 4) AS post_reddit_id, link_id AS post_reddit_fullname, coalesce(CASE WHEN starts_with(permalink, '/') THEN permalink WHEN permalink != '' THEN '/' || permalink END, '/r/' || subreddit || '/comments/' || substr(link_id, 4) || '/_/' || id || '/') AS permalink, strftime(to_timestamp(created_utc), '%Y-%m') AS month FROM comments WHERE {_ELIGIBLE}")
def comment_exports(spark: SparkSession, sf: str) -> DataFrame:
    """The export form of eligible comments: full names, link, month."""
    made = F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"), F.expr("substr(link_id, 4)"), F.lit("/_/"), F.col("id"), F.lit("/"))
    link = F.when(F.col("permalink").startswith("/"), F.col("permalink")).when(F.col("permalink") != "", F.concat(F.lit("/"), F.col("permalink")))
    return eligible(table(spark, sf, "comments")).select(
        F.col("id").alias("comment_id"),
        F.concat(F.lit("t1_"), F.col("id")).alias("comment_fullname"),
        F.expr("substr(link_id, 4)").alias("post_reddit_id"),
        F.col("link_id").alias("post_reddit_fullname"),
        F.coalesce(link, made).alias("permalink"),
        F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month"),
    )


@query("wrong_month_files", "SELECT source_file, strftime(to_timestamp(created_utc), '%Y-%m') AS month, count(*) AS n FROM comments GROUP BY ALL")
def wrong_month_files(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per file and month of writing: late downloads sit in another month's file."""
    return table(spark, sf, "comments").groupBy("source_file", F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("mega_threads", "WITH n AS (SELECT subreddit, link_id, count(*) AS n FROM comments GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, link_id) AS rank FROM n) SELECT * FROM r WHERE rank <= 5")
def mega_threads(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "comments").groupBy("subreddit", "link_id").agg(F.count("*").alias("n"))
    return windows.top_per_group(n, ["subreddit"], [F.desc("n"), F.asc("link_id")], 5)


@query("unscored_comments", "SELECT subreddit, count(DISTINCT id) AS n FROM comments WHERE id IS NOT NULL AND id NOT IN (SELECT comment_id FROM toxicity_scores WHERE comment_id IS NOT NULL) GROUP BY 1")
def unscored_comments(spark: SparkSession, sf: str) -> DataFrame:
    """Comments without any score."""
    scored = table(spark, sf, "toxicity_scores").select(F.col("comment_id").alias("id"))
    return table(spark, sf, "comments").where("id IS NOT NULL").join(scored, "id", "left_anti").groupBy("subreddit").agg(F.count_distinct("id").alias("n"))


@query("orphans", "SELECT subreddit, count(*) AS n FROM comments WHERE starts_with(parent_id, 't1_') AND substr(parent_id, 4) NOT IN (SELECT id FROM comments WHERE id IS NOT NULL) GROUP BY 1")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Replies whose parent is not among the comments."""
    c = table(spark, sf, "comments")
    known = c.where("id IS NOT NULL").select(F.col("id").alias("up")).distinct()
    return c.where(F.col("parent_id").startswith("t1_")).withColumn("up", F.expr("substr(parent_id, 4)")).join(known, "up", "left_anti").groupBy("subreddit").agg(F.count("*").alias("n"))
