"""Batches, shards, quotas, splits, plans of calls, and rows of several sources in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import parse, text
from quorate.functions.keys import folded, stripped, usable
from quorate.operators import ranks, sampling, select, windows
from quorate.plans.common import SPACE, table
from quorate.plans.registry import query

_H = "sha256('42:' || message_id)"
_SIDE = "CASE WHEN cell LIKE '%keep' THEN 'keep' ELSE 'remove' END"


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    side = F.when(F.col("cell").endswith("keep"), "keep").otherwise("remove")
    return table(spark, sf, "four_cell_cohort").select("message_id", "cell", side.alias("decision"), "original_text")


@query("paired_batches", f"WITH r AS (SELECT message_id, {_SIDE} AS decision, row_number() OVER (PARTITION BY {_SIDE} ORDER BY message_id) - 1 AS i, count(*) OVER (PARTITION BY {_SIDE}) AS n FROM four_cell_cohort), b AS (SELECT *, floor(i / 5)::INT AS batch_id FROM r), m AS (SELECT min(floor(n / 5)) AS n FROM r) SELECT message_id, decision, batch_id FROM b, m WHERE batch_id < m.n")
def paired_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of five kept and five removed posts, as many as both sides fill."""
    return select.paired_batches(_cohort(spark, sf).select("message_id", "decision"), "decision", ["message_id"], 5)


@query("chunks", f"SELECT cell, message_id, ceil(row_number() OVER (PARTITION BY cell ORDER BY message_id) / 12)::INT AS chunk, ceil(count(*) OVER (PARTITION BY cell) / 12)::INT AS n_chunks FROM four_cell_cohort")
def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Posts of each cell in chunks of twelve, the last one smaller, and how many chunks there are."""
    d = ranks.ranked(_cohort(spark, sf).select("cell", "message_id"), ["cell"], ["message_id"], "r", "n")
    return d.select("cell", "message_id", F.ceil(F.col("r") / 12).cast("int").alias("chunk"), F.ceil(F.col("n") / 12).cast("int").alias("n_chunks"))


@query("sized_shards", "WITH RECURSIVE l AS (SELECT cluster_id, feature_id, length(coalesce(feature_value, '')) AS size, row_number() OVER (PARTITION BY cluster_id ORDER BY feature_id) AS i FROM assignments_hdbscan WHERE cluster_id >= 0), w(cluster_id, feature_id, i, held, shard) AS (SELECT cluster_id, feature_id, i, size, 0 FROM l WHERE i = 1 UNION ALL SELECT l.cluster_id, l.feature_id, l.i, CASE WHEN held + l.size > 400 THEN l.size ELSE held + l.size END, CASE WHEN held + l.size > 400 THEN shard + 1 ELSE shard END FROM w JOIN l ON l.cluster_id = w.cluster_id AND l.i = w.i + 1) SELECT cluster_id, feature_id, shard::INT AS shard FROM w")
def sized_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Records of each cluster, in order, in shards of at most 400 characters."""
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id >= 0").select("cluster_id", "feature_id", text.char_count("feature_value").alias("size"))
    return select.sized_shards(a, "cluster_id", "feature_id", "size", 400).select("cluster_id", "feature_id", "shard")


@query("tier_quotas", f"WITH t AS (SELECT * FROM (VALUES ('sample_low_toxicity', 1), ('sample_middle_toxicity', 2), ('sample_high_toxicity', 3)) v(tier, i)), a AS (SELECT lower(trim(sample_toxicity_type, {SPACE})) AS tier, count(*) AS available FROM four_cell_cohort GROUP BY 1) SELECT t.tier, 33 + CASE WHEN i <= 1 THEN 1 ELSE 0 END AS quota, coalesce(available, 0) AS available, least(33 + CASE WHEN i <= 1 THEN 1 ELSE 0 END, coalesce(available, 0)) AS drawn FROM t LEFT JOIN a USING (tier)")
def tier_quotas(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred posts shared evenly among the tiers of toxicity, the rest to the first ones."""
    even = select.even_quotas(100, ["sample_low_toxicity", "sample_middle_toxicity", "sample_high_toxicity"])
    t = spark.createDataFrame(list(even.items()), "tier string, quota int")
    a = table(spark, sf, "four_cell_cohort").groupBy(folded("sample_toxicity_type").alias("tier")).agg(F.count("*").alias("available"))
    n = F.coalesce("available", F.lit(0))
    return t.join(a, "tier", "left").select("tier", "quota", n.alias("available"), F.least("quota", n).alias("drawn"))


@query("waterfall_sample", f"WITH p AS (SELECT lower(trim(sample_toxicity_type, {SPACE})) AS tier, split_part(message_id, '_', 1) AS platform, message_id, row_number() OVER (PARTITION BY lower(trim(sample_toxicity_type, {SPACE})), split_part(message_id, '_', 1) ORDER BY {_H}, message_id) AS r FROM four_cell_cohort WHERE coalesce(lower(trim(sample_toxicity_type, {SPACE})) NOT IN ('', 'nan'), false)), c AS (SELECT tier, count(*) FILTER (WHERE platform = 'twitter') AS a, count(*) FILTER (WHERE platform = 'bluesky') AS b, count(*) FILTER (WHERE platform = 'reddit') AS c FROM p GROUP BY 1), q AS (SELECT tier, least(60, a) AS qa, 60 - least(60, a) AS rest, b, c FROM c), h AS (SELECT *, least(b, rest // 2) AS b1 FROM q), i AS (SELECT *, least(c, rest - b1) AS c1 FROM h), j AS (SELECT *, b1 + least(b - b1, greatest(rest - b1 - c1, 0)) AS b2 FROM i), k AS (SELECT *, c1 + least(c - c1, greatest(rest - b2 - c1, 0)) AS c2 FROM j) SELECT p.tier, platform, message_id FROM p JOIN k USING (tier) WHERE r <= CASE platform WHEN 'twitter' THEN qa WHEN 'bluesky' THEN b2 WHEN 'reddit' THEN c2 ELSE 0 END")
def waterfall_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty posts of each tier: from the first platform, the rest half and half from two others, which fill in for each other."""
    d = table(spark, sf, "four_cell_cohort").where(usable("sample_toxicity_type")).select(folded("sample_toxicity_type").alias("tier"), F.substring_index("message_id", "_", 1).alias("platform"), "message_id")
    return select.waterfall(d, "message_id", "tier", "platform", ("twitter", "bluesky", "reddit"), 60, 42).select("tier", "platform", "message_id")


@query("prefix_split", f"WITH r AS (SELECT message_id, row_number() OVER (ORDER BY {_H}, message_id) AS r, count(*) OVER () AS n FROM four_cell_cohort) SELECT message_id, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM r")
def prefix_split(spark: SparkSession, sf: str) -> DataFrame:
    """All posts in random order: the first four fifths for training."""
    return sampling.split(_cohort(spark, sf).select("message_id"), "message_id", [], [("train", 0.8), ("test", 0.2)])


@query("balanced_split", f"WITH r AS (SELECT message_id, {_SIDE} AS decision, row_number() OVER (PARTITION BY {_SIDE} ORDER BY {_H}, message_id) AS r FROM four_cell_cohort), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM r GROUP BY decision)) SELECT message_id, decision, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'train' ELSE 'test' END AS split FROM r, m WHERE r <= n")
def balanced_split(spark: SparkSession, sf: str) -> DataFrame:
    """As many posts of both decisions as the rarer one has, four fifths of each for training."""
    return select.balanced_split(_cohort(spark, sf).select("message_id", "decision"), "message_id", "decision", 0.8, 42)


@query("learning_curve", f"WITH r AS (SELECT message_id, {_SIDE} AS decision, row_number() OVER (PARTITION BY {_SIDE} ORDER BY {_H}, message_id) AS r, count(*) OVER (PARTITION BY {_SIDE}) AS n FROM four_cell_cohort), f AS (SELECT i / 10.0::DOUBLE AS fraction FROM range(1, 10) t(i)) SELECT fraction, decision, count(*) FILTER (WHERE r <= floor(n * fraction + 1e-9)) AS n_train, count(*) FILTER (WHERE r > floor(n * fraction + 1e-9)) AS n_test FROM r, f GROUP BY ALL")
def learning_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Training and test posts of both decisions for fractions from a tenth to nine."""
    return select.learning_curve(_cohort(spark, sf).select("message_id", "decision"), "message_id", ["decision"], [i / 10.0 for i in range(1, 10)], 42)


@query("swapped_pairs", "SELECT message_id, ('0x' || left(sha256('42:' || message_id), 8))::BIGINT % 2 = 1 AS swapped FROM four_cell_cohort")
def swapped_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a prompt shows the two texts of a post the other way round."""
    return _cohort(spark, sf).select("message_id", select.swapped("message_id", 42).alias("swapped"))


@query("fresh_sample", f"WITH t AS (SELECT DISTINCT unnest(test_post_ids) AS message_id FROM split_ids), c AS (SELECT message_id, cell FROM four_cell_cohort ANTI JOIN t USING (message_id)), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY {_H}, message_id) AS r, count(*) OVER (PARTITION BY cell) AS n FROM c) SELECT message_id, cell FROM r WHERE r <= ceil(n * 0.1)")
def fresh_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of each cell, without the posts of the test splits."""
    used = table(spark, sf, "split_ids").select(F.explode("test_post_ids").alias("message_id")).distinct()
    return sampling.share_per_class(_cohort(spark, sf).select("message_id", "cell").join(used, "message_id", "left_anti"), "message_id", ["cell"], 0.1)


@query("batch_plan", "WITH b AS (SELECT post_primary_key AS id, model_name AS bucket, min(flip_id) AS first, CASE model_name WHEN 'mirror-small' THEN 1 WHEN 'mirror-large' THEN 2 ELSE 3 END AS o FROM flips GROUP BY 1, 2), u AS (SELECT id, bucket, first FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY o) = 1), r AS (SELECT *, floor((row_number() OVER (PARTITION BY bucket ORDER BY first) - 1) / 25)::INT AS chunk FROM u) SELECT bucket, chunk, id FROM r WHERE chunk < 4")
def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Four chunks of 25 posts a model (the size of the plan); a post goes to the first model that has it."""
    f = table(spark, sf, "flips")
    order = F.when(F.col("model_name") == "mirror-small", 1).when(F.col("model_name") == "mirror-large", 2).otherwise(3)
    b = f.groupBy(F.col("post_primary_key").alias("id"), F.col("model_name").alias("bucket")).agg(F.min("flip_id").alias("first")).withColumn("o", F.when(F.col("bucket") == "mirror-small", 1).when(F.col("bucket") == "mirror-large", 2).otherwise(3))
    u = windows.first_per_key(b, ["id"], ["o"])
    return windows.batches(u, ["bucket"], ["first"], 25, name="chunk").where("chunk < 4").select("bucket", "chunk", "id")


@query("response_issues", "WITH a AS (SELECT DISTINCT message_id AS id FROM four_cell_cohort), r AS (SELECT post_primary_key AS id, count(*) AS n FROM flips GROUP BY 1) SELECT CASE WHEN r.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unknown' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS issue, count(*) AS n_ids FROM a FULL JOIN r ON a.id = r.id GROUP BY 1")
def response_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Asked and answered ids: missing, unknown, answered twice, in order."""
    asked = table(spark, sf, "four_cell_cohort").select(F.col("message_id").alias("id"))
    return select.response_issues(asked, table(spark, sf, "flips").select(F.col("post_primary_key").alias("id")), "id").groupBy("issue").agg(F.count("*").alias("n_ids"))


@query("granted_calls", "WITH n AS (SELECT model_name AS bucket, count(*) AS need, CASE model_name WHEN 'mirror-small' THEN 1 WHEN 'mirror-large' THEN 2 ELSE 3 END AS o FROM flips GROUP BY 1), b AS (SELECT *, 300 - (sum(need) OVER (ORDER BY o) - need) AS left_over FROM n) SELECT bucket, need, greatest(least(need, left_over), 0)::BIGINT AS granted, need - greatest(least(need, left_over), 0)::BIGINT AS refused FROM b")
def granted_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Three hundred calls given to the models in turn, each as many as it needs while they last."""
    n = table(spark, sf, "flips").groupBy(F.col("model_name").alias("bucket")).agg(F.count("*").alias("need"))
    n = n.withColumn("o", F.when(F.col("bucket") == "mirror-small", 1).when(F.col("bucket") == "mirror-large", 2).otherwise(3))
    return select.apportion(n, "need", ["o"], 300).select("bucket", "need", "granted", "refused")


@query("cluster_samples", "WITH r AS (SELECT cluster_id, feature_id, row_number() OVER (PARTITION BY cluster_id ORDER BY sha256('42:' || feature_id), feature_id) AS r FROM assignments_hdbscan WHERE cluster_id != -1) SELECT cluster_id, count(*) AS n, string_agg(feature_id, ',' ORDER BY r) AS sampled FROM r WHERE r <= 5 GROUP BY 1")
def cluster_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Five records of each cluster to be named by, noise left out."""
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id != -1").select("cluster_id", "feature_id", sampling.hash_order(42, "feature_id").alias("h"))
    top = windows.top_per_group(a, ["cluster_id"], [F.asc("h"), F.asc("feature_id")], 5, "r")
    return top.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "feature_id"))), lambda x: x["feature_id"]), ",").alias("sampled"))


@query("repeated_batch_ids", "WITH i AS (SELECT split_id, unnest(list_distinct(list_filter(test_post_ids, lambda x: x IS NOT NULL))) AS id FROM split_ids) SELECT id, count(*) AS n_splits FROM i GROUP BY 1 HAVING count(*) > 1")
def repeated_batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that are in more than one test split."""
    return select.repeated(table(spark, sf, "split_ids"), "test_post_ids", "id", "n_splits")


@query("resorted_sample", f"WITH s AS (SELECT message_id, cell FROM four_cell_cohort ORDER BY {_H}, message_id LIMIT 40) SELECT message_id, cell, row_number() OVER (ORDER BY message_id) AS place FROM s")
def resorted_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Forty random posts, numbered in their original order."""
    s = sampling.sample(_cohort(spark, sf).select("message_id", "cell"), "message_id", 40)
    return ranks.ranked(s, [], ["message_id"], "place")


@query("one_per_subreddit", "SELECT lower(trim(subreddit)) AS subreddit, arg_min(comment_id, (sha256('9:' || comment_id), comment_id)) AS comment_id FROM mirrorview_comments WHERE subreddit IS NOT NULL AND comment_id IS NOT NULL GROUP BY 1")
def one_per_subreddit(spark: SparkSession, sf: str) -> DataFrame:
    """One random comment of each subreddit."""
    c = table(spark, sf, "mirrorview_comments").where("subreddit IS NOT NULL AND comment_id IS NOT NULL").select(F.lower(F.trim("subreddit")).alias("subreddit"), "comment_id", sampling.hash_order(9, "comment_id").alias("h"))
    return windows.first_per_key(c, ["subreddit"], ["h", "comment_id"]).select("subreddit", "comment_id")


_ORDER = "CASE condition WHEN 'control' THEN 1 WHEN 'training' THEN 2 WHEN 'training_assisted' THEN 3 ELSE 4 END"


@query("ordered_groups", f"WITH g AS (SELECT DISTINCT party_group, condition FROM trials WHERE party_group IS NOT NULL AND condition IS NOT NULL) SELECT party_group, condition, row_number() OVER (ORDER BY party_group, {_ORDER}) AS place FROM g")
def ordered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The combinations of party and condition that occur, in their canonical order."""
    g = table(spark, sf, "trials").where("party_group IS NOT NULL AND condition IS NOT NULL").select("party_group", "condition").distinct()
    order = F.when(F.col("condition") == "control", 1).when(F.col("condition") == "training", 2).when(F.col("condition") == "training_assisted", 3).otherwise(4)
    return ranks.ranked(g.withColumn("o", order), [], ["party_group", "o"], "place").drop("o")


@query("valid_people", f"SELECT CASE WHEN prolific_id IS NULL OR trim(prolific_id, {SPACE}) = '' THEN 'none' WHEN regexp_matches(prolific_id, '^manual-test-') THEN 'manual' WHEN contains(lower(prolific_id), 'pid') THEN 'placeholder' ELSE 'valid' END AS kind, count(*) AS n_rows, count(DISTINCT participant_id) AS n_people FROM trials GROUP BY 1")
def valid_people(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and participants by the kind of their account id."""
    p = F.col("prolific_id")
    kind = F.when(p.isNull() | (stripped("prolific_id") == ""), "none").when(p.rlike("^manual-test-"), "manual").when(F.lower(p).contains("pid"), "placeholder").otherwise("valid")
    return table(spark, sf, "trials").groupBy(kind.alias("kind")).agg(F.count("*").alias("n_rows"), F.count_distinct("participant_id").alias("n_people"))


@query("phase_trials", f"WITH x AS (SELECT trial_row_id, TRY_CAST(trim(phase, {SPACE}) AS DOUBLE) AS phase, lower(trim(evaluation_mode, {SPACE})) AS mode FROM trials WHERE trial_type = 'moderation-trial' AND trim(coalesce(original_text, ''), {SPACE}) != '' AND trim(coalesce(mirror_text, ''), {SPACE}) != '') SELECT phase::INT AS phase, mode, count(*) AS n FROM x WHERE phase > 0 AND mode IN ('linked_fate', 'assisted') GROUP BY ALL")
def phase_trials(spark: SparkSession, sf: str) -> DataFrame:
    """Moderation trials of a numbered phase with both texts, in the two paired modes."""
    t = table(spark, sf, "trials")
    x = select.pilot_trials(t).where((F.coalesce(stripped("original_text"), F.lit("")) != "") & (F.coalesce(stripped("mirror_text"), F.lit("")) != ""))
    return x.where(folded("evaluation_mode").isin("linked_fate", "assisted")).groupBy(F.col("phase").cast("int").alias("phase"), folded("evaluation_mode").alias("mode")).agg(F.count("*").alias("n"))


@query("platform_tiers", f"WITH x AS (SELECT split_part(message_id, '_', 1) AS platform, CASE lower(trim(sample_toxicity_type, {SPACE})) WHEN 'sample_low_toxicity' THEN 'low' WHEN 'sample_middle_toxicity' THEN 'middle' WHEN 'sample_high_toxicity' THEN 'high' END AS tier FROM four_cell_cohort WHERE coalesce(lower(trim(sample_toxicity_type, {SPACE})) NOT IN ('', 'nan'), false)) SELECT platform, count(*) FILTER (WHERE tier = 'low') AS n_low, count(*) FILTER (WHERE tier = 'middle') AS n_middle, count(*) FILTER (WHERE tier = 'high') AS n_high, count(*) FILTER (WHERE tier IN ('low', 'middle', 'high')) AS n_total FROM x GROUP BY 1")
def platform_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by platform and tier; an unknown prefix or tier is an error."""
    from quorate.operators import aggregate

    x = table(spark, sf, "four_cell_cohort").where(usable("sample_toxicity_type")).select(parse.platform("message_id").alias("platform"), parse.mapped("sample_toxicity_type", parse.TIERS, "tier").alias("tier"))
    return aggregate.crosstab(x, "platform", "tier", ["low", "middle", "high"])


@query("flipped_stances", f"SELECT flip_id, CASE lower(trim(sampled_stance, {SPACE})) WHEN 'left' THEN 'right' WHEN 'right' THEN 'left' END AS target_stance FROM flips")
def flipped_stances(spark: SparkSession, sf: str) -> DataFrame:
    """The stance that a flip is to take; an unknown one is an error."""
    return table(spark, sf, "flips").select("flip_id", parse.mapped("sampled_stance", parse.OTHER_STANCE, "stance").alias("target_stance"))


@query("local_times")
def local_times(spark: SparkSession, sf: str) -> DataFrame:
    """When synced comments were written, in local time with its offset, from the seconds of their download."""
    m = table(spark, sf, "mirrorview_comments").select(F.col("comment_id").alias("id")).distinct()
    c = table(spark, sf, "comments").groupBy("id").agg(F.min("created_utc").alias("s"))
    return c.join(m, "id").select(F.col("id").alias("comment_id"), parse.local_time("s").alias("local_time"))


@query("sync_lags", "WITH x AS (SELECT comment_id, try_strptime(sync_timestamp, '%Y_%m_%d-%H:%M:%S') AS synced, try_strptime(left(created_utc, 19), '%Y-%m-%d %H:%M:%S') AS created FROM mirrorview_comments) SELECT count(*) AS n, count(synced) AS n_synced, count(*) FILTER (WHERE created < synced - INTERVAL 20 MINUTE) AS n_settled, min(synced) AS first_sync FROM x")
def sync_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Syncs with a readable time, and comments written more than twenty minutes before."""
    synced = parse.run_time("sync_timestamp").cast("timestamp_ntz")
    created = F.try_to_timestamp(F.substring("created_utc", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    x = table(spark, sf, "mirrorview_comments").select(synced.alias("synced"), created.alias("created"))
    return x.agg(F.count("*").alias("n"), F.count("synced").alias("n_synced"), F.count_if(F.col("created") < F.col("synced") - F.expr("INTERVAL 20 MINUTES")).alias("n_settled"), F.min("synced").alias("first_sync"))


@query("unified_sources", f"WITH u AS (SELECT 'flips' AS integration, post_primary_key AS id, original_text AS text, lower(trim(sampled_stance, {SPACE})) AS stance FROM flips UNION ALL SELECT 'cohort', message_id, original_text, lower(trim(sampled_stance, {SPACE})) FROM four_cell_cohort UNION ALL SELECT 'comments', 'reddit_' || id, body, NULL FROM comments UNION ALL SELECT 'documents', sha256(coalesce(text, '')), text, NULL FROM documents) SELECT integration, count(*) AS n, count(DISTINCT id) AS n_ids, count(stance) AS n_stances FROM u WHERE text IS NOT NULL AND coalesce(stance, '') NOT IN ('unclear', 'neutral') GROUP BY 1")
def unified_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of four sources in one form: integration, id (made where there is none), text, stance; unclear stances drop out."""
    none = F.lit(None).cast("string")
    sources = {
        "flips": (F.col("post_primary_key"), F.col("original_text"), folded("sampled_stance")),
        "four_cell_cohort": (F.col("message_id"), F.col("original_text"), folded("sampled_stance")),
        "comments": (F.concat(F.lit("reddit_"), "id"), F.col("body"), none),
        "documents": (F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text"), none),
    }
    u = select.unified({("cohort" if n == "four_cell_cohort" else n): (table(spark, sf, n), dict(zip(("id", "text", "stance"), c, strict=True))) for n, c in sources.items()}, "integration")
    u = u.where(F.col("text").isNotNull() & ~F.coalesce("stance", F.lit("")).isin("unclear", "neutral"))
    return u.groupBy("integration").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count("stance").alias("n_stances"))


@query("file_kinds", "WITH f AS (SELECT DISTINCT source_file || CASE WHEN ascii(right(source_file, 1)) % 3 = 0 THEN '.zst' WHEN ascii(right(source_file, 1)) % 3 = 1 THEN '_comments.parquet' ELSE '.PARQUET' END AS name FROM comments WHERE source_file IS NOT NULL) SELECT name, CASE WHEN lower(name) LIKE 'rc\\_%.zst' ESCAPE '\\' THEN 'comment_zst' WHEN lower(name) LIKE 'rs\\_%.zst' ESCAPE '\\' THEN 'submission_zst' WHEN lower(name) LIKE '%.parquet' THEN CASE WHEN contains(lower(name), 'comment') THEN 'comment_parquet' WHEN contains(lower(name), 'submission') THEN 'submission_parquet' ELSE 'parquet_other' END ELSE 'other' END AS kind, nullif(regexp_extract(name, '(RC|RS)_(\\d{4}-\\d{2})', 2), '') AS month FROM f")
def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kind and month of files by their names."""
    from quorate.sources import catalog

    last = F.ascii(F.expr("right(source_file, 1)")) % 3
    f = table(spark, sf, "comments").where("source_file IS NOT NULL").select(F.concat("source_file", F.when(last == 0, ".zst").when(last == 1, "_comments.parquet").otherwise(".PARQUET")).alias("name")).distinct()
    return f.select("name", catalog.file_kind(F.col("name")).alias("kind"), catalog.file_month(F.col("name")).alias("month"))
