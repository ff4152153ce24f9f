"""Texts, labels and vectors of posts under several roles, and comparisons of two versions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import keys, lexicon, text, vectors
from quorate.operators import ranks, reshape, windows
from quorate.plans.common import SPACE, table
from quorate.plans.registry import query

ROLES = {"original": "original_text", "mirror": "mirror_text"}


def _norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({c}, ''), '\\r\\n?', E'\\n', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), E' \\t\\n')"


def _cohort(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "four_cell_cohort")


_LONG = f"""l AS (SELECT message_id, 'original' AS role, original_text AS text FROM four_cell_cohort UNION ALL SELECT message_id, 'mirror', mirror_text FROM four_cell_cohort),
 i AS (SELECT message_id, role, sha256({_norm('text')}) AS text_hash, min(text) AS text FROM l WHERE message_id IS NOT NULL AND {_norm('text')} != '' GROUP BY ALL)"""


@query("text_instances", f"WITH {_LONG} SELECT message_id, role, text_hash, length(text) AS n_chars FROM i")
def text_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of a post with its role and hash."""
    return reshape.instances(_cohort(spark, sf), "message_id", ROLES).select("message_id", "role", "text_hash", F.length("text").alias("n_chars"))


@query("pair_hashes", f"SELECT message_id, sha256({_norm('original_text')}) AS original_hash, sha256({_norm('mirror_text')}) AS mirror_hash, sha256(sha256({_norm('original_text')}) || '||' || sha256({_norm('mirror_text')})) AS pair_hash FROM four_cell_cohort")
def pair_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of both texts of a post, and of the pair."""
    return _cohort(spark, sf).select("message_id", text.text_hash("original_text").alias("original_hash"), text.text_hash("mirror_text").alias("mirror_hash"), text.pair_hash("original_text", "mirror_text").alias("pair_hash"))


@query("embedding_identities", f"""SELECT doc_id, sha256('v1' || chr(10) || '{{"dimensions":256,"model_id":"embed-v2","normalize":true,"text":' || to_json(trim(text, {SPACE}))::VARCHAR || '}}') AS embedding_id FROM documents WHERE text IS NOT NULL""")
def embedding_identities(spark: SparkSession, sf: str) -> DataFrame:
    """The key under which the embedding of a text is stored."""
    d = table(spark, sf, "documents").where("text IS NOT NULL")
    return d.select("doc_id", text.embedding_identity("text", "embed-v2", 256, True).alias("embedding_id"))


#: A vector store by text hash: a text's vector is the one whose id its hash names; some texts have none.
def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    wide = _cohort(spark, sf).select("message_id", *[F.when(text.normalized(c) != "", text.text_hash(c)).alias(f"{r}_hash") for r, c in ROLES.items()])
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    hashes = wide.select(F.explode(F.array("original_hash", "mirror_hash")).alias("text_hash")).where("text_hash IS NOT NULL").distinct()
    number = (F.conv(F.substring("text_hash", 1, 7), 16, 10).cast("bigint") % 600).alias("vec_id")
    return wide, hashes.select("text_hash", number).join(e, "vec_id").select("text_hash", "embedding")


_STORED = f"""w AS (SELECT message_id, CASE WHEN {_norm('original_text')} != '' THEN sha256({_norm('original_text')}) END AS o, CASE WHEN {_norm('mirror_text')} != '' THEN sha256({_norm('mirror_text')}) END AS m FROM four_cell_cohort),
 h AS (SELECT DISTINCT x FROM (SELECT o AS x FROM w UNION ALL SELECT m FROM w) WHERE x IS NOT NULL),
 v AS (SELECT x, embedding FROM h JOIN embeddings ON vec_id = ('0x' || left(x, 7))::BIGINT % 600),
 j AS (SELECT message_id, a.embedding AS eo, b.embedding AS em FROM w LEFT JOIN v a ON a.x = o LEFT JOIN v b ON b.x = m)"""
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    wide, stored = _stored(spark, sf)
    return reshape.join_roles(wide, {"original": "original_hash", "mirror": "mirror_hash"}, stored, "text_hash", "embedding")


@query("role_vectors", f"WITH {_STORED} SELECT message_id, round({_DOT.format('eo', 'em')} / sqrt({_DOT.format('eo', 'eo')} * {_DOT.format('em', 'em')}), 4) AS cosine, len(eo) * 2 + 1 AS n_features FROM j WHERE eo IS NOT NULL AND em IS NOT NULL")
def role_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Cosine of the vectors of a post's two texts, where both are stored, and the size of their feature row."""
    both = _joined(spark, sf).where("original_embedding IS NOT NULL AND mirror_embedding IS NOT NULL")
    return both.select("message_id", F.round(vectors.cosine("original_embedding", "mirror_embedding"), 4).alias("cosine"), F.size(vectors.with_cosine("original_embedding", "mirror_embedding")).cast("long").alias("n_features"))


@query("vector_coverage", f"WITH {_STORED}, l AS (SELECT 'original' AS role, eo AS e FROM j UNION ALL SELECT 'mirror', em FROM j) SELECT role, count(e) AS n_hit, count(*) - count(e) AS n_miss, round(count(e) / count(*), 6) AS share FROM l GROUP BY 1")
def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with and without a stored vector, per role."""
    long = _joined(spark, sf).select(F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_embedding").alias("e")) for r in ROLES])).alias("x")).select("x.role", "x.e")
    return reshape.coverage(long, "e", ["role"])


@query("vector_reconciliation", "WITH e AS (SELECT vec_id, label FROM embeddings), s AS (SELECT vec_id + 3 AS vec_id, label FROM embeddings) SELECT CASE WHEN s.vec_id IS NULL THEN 'missing' WHEN e.vec_id IS NULL THEN 'unexpected' WHEN e.label IS NOT DISTINCT FROM s.label THEN 'same' ELSE 'changed' END AS reason, count(*) AS n FROM e FULL JOIN s ON e.vec_id = s.vec_id GROUP BY 1")
def vector_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Two versions of a store compared: same, changed, missing, unexpected."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return reshape.reconcile(e, e.withColumn("vec_id", F.col("vec_id") + 3), "vec_id", "label").groupBy("reason").agg(F.count("*").alias("n"))


_WORDS = {n: f"regexp_matches(lower(coalesce({{0}}, '')), '\\b(?:{w})\\b')" for n, w in lexicon.CLASSIFIERS.items()}


@query("text_labels", "SELECT message_id, " + ", ".join(f"{e.format(c)} AS {r}_{n}" for r, c in ROLES.items() for n, e in _WORDS.items()) + " FROM four_cell_cohort")
def text_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Both texts of every post under the three classifiers."""
    return _cohort(spark, sf).select("message_id", *[lexicon.classify(n, c).alias(f"{r}_{n}") for r, c in ROLES.items() for n in lexicon.CLASSIFIERS])


_PAIRS = " UNION ALL ".join(f"SELECT '{n}' AS label, ({e.format('original_text')})::INT AS o, ({e.format('mirror_text')})::INT AS m FROM four_cell_cohort" for n, e in _WORDS.items())


@query("label_agreement", f"SELECT label, count(*) AS n, round(avg((o = m)::INT), 6) AS match_rate, round(avg((m > o)::INT), 6) AS more_rate, round(avg((m < o)::INT), 6) AS less_rate FROM ({_PAIRS}) GROUP BY 1")
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often the mirror has the label of the original, more of it, or less."""
    d = _cohort(spark, sf)
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), lexicon.classify(n, "original_text").cast("int").alias("o"), lexicon.classify(n, "mirror_text").cast("int").alias("m")) for n in lexicon.CLASSIFIERS]))
    rate = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    o, m = F.col("o"), F.col("m")
    return d.select(rows.alias("x")).select("x.*").groupBy("label").agg(F.count("*").alias("n"), rate(o == m, "match_rate"), rate(m > o, "more_rate"), rate(m < o, "less_rate"))


@query("normalized_matches", "WITH n AS (SELECT flip_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(coalesce(original_text, ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS t FROM flips), c AS (SELECT message_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(coalesce(original_text, ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '\\s+', ' ', 'g')) AS t FROM four_cell_cohort) SELECT message_id, count(*) AS n_flips, min(flip_id) AS first_flip FROM n JOIN c USING (t) WHERE t != '' GROUP BY 1")
def normalized_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Cohort posts whose original text, entities and white space set aside, was flipped."""
    f = table(spark, sf, "flips").select("flip_id", text.plain_entities("original_text").alias("t")).where("t != ''")
    c = _cohort(spark, sf).select("message_id", text.plain_entities("original_text").alias("t"))
    return f.join(c, "t").groupBy("message_id").agg(F.count("*").alias("n_flips"), F.min("flip_id").alias("first_flip"))


@query("shared_texts", f"WITH a AS (SELECT DISTINCT original_text AS t FROM flips WHERE original_text IS NOT NULL), b AS (SELECT DISTINCT original_text AS t FROM four_cell_cohort WHERE original_text IS NOT NULL), c AS (SELECT DISTINCT lower({_norm('original_text')}) AS t FROM flips WHERE original_text IS NOT NULL), d AS (SELECT DISTINCT lower({_norm('original_text')}) AS t FROM four_cell_cohort WHERE original_text IS NOT NULL) SELECT 'raw' AS form, (SELECT count(*) FROM a) AS n_flips, (SELECT count(*) FROM b) AS n_cohort, (SELECT count(*) FROM a SEMI JOIN b USING (t)) AS n_shared UNION ALL SELECT 'normal', (SELECT count(*) FROM c), (SELECT count(*) FROM d), (SELECT count(*) FROM c SEMI JOIN d USING (t))")
def shared_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct original texts that flips and cohort share, raw and normalised."""
    parts = []
    for form, c in (("raw", F.col("original_text")), ("normal", F.lower(text.normalized("original_text")))):
        a, b = (table(spark, sf, t).where("original_text IS NOT NULL").select(c.alias("t")).distinct() for t in ("flips", "four_cell_cohort"))
        both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "t", "full")
        parts.append(both.agg(F.lit(form).alias("form"), F.count("a").alias("n_flips"), F.count("b").alias("n_cohort"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_shared")))
    return parts[0].unionByName(parts[1])


@query("needed_hashes", f"WITH n AS (SELECT DISTINCT sha256({_norm('original_text')}) AS h FROM four_cell_cohort), k AS (SELECT DISTINCT sha256({_norm('original_text')}) AS h FROM flips) SELECT count(*) AS n_needed, count(k.h) AS n_known, count(*) - count(k.h) AS n_left, round(count(k.h) / count(*), 6) AS coverage FROM n LEFT JOIN k USING (h)")
def needed_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes of cohort texts that the flips know already, and what is left to do."""
    n = _cohort(spark, sf).select(text.text_hash("original_text").alias("h")).distinct()
    k = table(spark, sf, "flips").select(text.text_hash("original_text").alias("h"), F.lit(1).alias("k")).distinct()
    return n.join(k, "h", "left").agg(F.count("*").alias("n_needed"), F.count("k").alias("n_known"), F.count_if(F.col("k").isNull()).alias("n_left"), F.round(F.count("k") / F.count("*"), 6).alias("coverage"))


MODELS = ["mirror-small", "mirror-large", "mirror-large-v2"]


@query("flips_by_model", "SELECT post_primary_key, " + ", ".join(f"arg_min(flip_id, flip_id) FILTER (WHERE model_name = '{m}') AS {m.replace('-', '_')}" for m in MODELS) + " FROM flips GROUP BY 1")
def flips_by_model(spark: SparkSession, sf: str) -> DataFrame:
    """The first flip of each post by each model, one column a model."""
    return reshape.wide(table(spark, sf, "flips"), "post_primary_key", "model_name", MODELS, "flip_id", "flip_id")


@query("flip_versions", "SELECT model_name, count(*) AS n, count(DISTINCT post_primary_key) AS n_posts, round(avg(length(flipped_text)), 6) AS mean_chars, round(avg(length(flipped_text) - length(original_text)), 6) AS mean_differential FROM flips GROUP BY 1")
def flip_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Posts, lengths and signed length differentials of each version of the flips."""
    a, b = F.length("original_text"), F.length("flipped_text")
    return table(spark, sf, "flips").groupBy("model_name").agg(F.count("*").alias("n"), F.count_distinct("post_primary_key").alias("n_posts"), F.round(F.avg(b), 6).alias("mean_chars"), F.round(F.avg(b - a), 6).alias("mean_differential"))


@query("largest_differentials", "SELECT flip_id, abs(length(flipped_text) - length(original_text)) AS differential FROM flips WHERE flipped_text IS NOT NULL AND original_text IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 20")
def largest_differentials(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty flips whose length differs most."""
    d = F.abs(F.length("flipped_text") - F.length("original_text"))
    return table(spark, sf, "flips").where("flipped_text IS NOT NULL AND original_text IS NOT NULL").select("flip_id", d.alias("differential")).orderBy(F.desc("differential"), "flip_id").limit(20)


@query("repaired_keys", "WITH k AS (SELECT DISTINCT id FROM comments WHERE id IS NOT NULL), l AS (SELECT substr(link_id, 4) AS post_reddit_id, body, min(id) AS one FROM comments WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) = 1), m AS (SELECT DISTINCT CASE WHEN comment_rank % 2 = 0 THEN comment_id ELSE 'x' || comment_id END AS id, post_reddit_id, body FROM mirrorview_comments) SELECT m.id, m.post_reddit_id, min(CASE WHEN k.id IS NOT NULL THEN m.id ELSE l.one END) AS repaired, count(*) AS n FROM m LEFT JOIN k ON k.id = m.id LEFT JOIN l ON l.post_reddit_id = m.post_reddit_id AND l.body = m.body GROUP BY 1, 2")
def repaired_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Synced comments, half of them with a spoilt id, that get it back by post and body."""
    m = table(spark, sf, "mirrorview_comments").select(F.when(F.col("comment_rank") % 2 == 0, F.col("comment_id")).otherwise(F.concat(F.lit("x"), F.col("comment_id"))).alias("id"), "post_reddit_id", "body").distinct()
    known = table(spark, sf, "comments").select("id", F.expr("substr(link_id, 4)").alias("post_reddit_id"), "body")
    return reshape.repaired(m, "id", ["post_reddit_id", "body"], known).groupBy("id", "post_reddit_id").agg(F.min("repaired").alias("repaired"), F.count("*").alias("n"))


@query("ordered_selection", "WITH t AS (SELECT split_id, unnest(test_post_ids) AS message_id, generate_subscripts(test_post_ids, 1) AS position FROM split_ids) SELECT split_id, position::BIGINT AS position, message_id, cell FROM t JOIN four_cell_cohort USING (message_id)")
def ordered_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Posts in the order of the ids of each test split."""
    ids = table(spark, sf, "split_ids").select("split_id", F.posexplode("test_post_ids").alias("p", "message_id"))
    return ids.join(_cohort(spark, sf).select("message_id", "cell"), "message_id").select("split_id", (F.col("p") + 1).cast("long").alias("position"), "message_id", "cell")


@query("cell_flips", "SELECT cell, count(*) AS n_flips, count(DISTINCT message_id) AS n_posts FROM flips JOIN four_cell_cohort ON message_id = post_primary_key GROUP BY 1")
def cell_flips(spark: SparkSession, sf: str) -> DataFrame:
    """Flips by the cell of their post; flips of other posts drop out."""
    c = _cohort(spark, sf).select(F.col("message_id").alias("post_primary_key"), "cell")
    return table(spark, sf, "flips").join(c, "post_primary_key").groupBy("cell").agg(F.count("*").alias("n_flips"), F.count_distinct("post_primary_key").alias("n_posts"))


@query("feature_star", "WITH r AS (SELECT trim(post_id) AS id, count(*) AS n_trials, count(DISTINCT participant_id) AS n_people FROM trials GROUP BY 1), f AS (SELECT post_primary_key AS id, count(*) AS n_flips FROM flips GROUP BY 1), h AS (SELECT message_id AS id, length(original_text) AS a, length(mirror_text) AS b, original_text, mirror_text FROM four_cell_cohort) SELECT c.message_id, coalesce(n_trials, 0) AS n_trials, coalesce(n_people, 0) AS n_people, coalesce(n_flips, 0) AS n_flips, a AS original_chars, b AS mirror_chars, CASE WHEN cell LIKE '%remove' THEN 1 ELSE 0 END AS label FROM four_cell_cohort c LEFT JOIN r ON r.id = c.message_id LEFT JOIN f ON f.id = c.message_id LEFT JOIN h ON h.id = c.message_id AND h.original_text IS NOT DISTINCT FROM c.original_text AND h.mirror_text IS NOT DISTINCT FROM c.mirror_text")
def feature_star(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows: labels of posts with features from four tables, the last joined by key and both texts."""
    c = _cohort(spark, sf).select("message_id", "original_text", "mirror_text", "cell")
    r = table(spark, sf, "trials").groupBy(F.trim("post_id").alias("message_id")).agg(F.count("*").alias("n_trials"), F.count_distinct("participant_id").alias("n_people"))
    f = table(spark, sf, "flips").groupBy(F.col("post_primary_key").alias("message_id")).agg(F.count("*").alias("n_flips"))
    h = c.select("message_id", "original_text", "mirror_text", F.length("original_text").cast("long").alias("original_chars"), F.length("mirror_text").cast("long").alias("mirror_chars"))
    same = (F.col("c.message_id") == F.col("h.message_id")) & F.col("c.original_text").eqNullSafe(F.col("h.original_text")) & F.col("c.mirror_text").eqNullSafe(F.col("h.mirror_text"))
    d = c.join(r, "message_id", "left").join(f, "message_id", "left").alias("c").join(h.alias("h"), same, "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return d.select("c.message_id", zero("n_trials"), zero("n_people"), zero("n_flips"), "original_chars", "mirror_chars", F.col("cell").endswith("remove").cast("int").alias("label"))


@query("prediction_status", "WITH s AS (SELECT comment_id, max(prob_toxic) AS p FROM toxicity_scores WHERE was_successfully_labeled AND prob_toxic BETWEEN 0 AND 1 GROUP BY 1), g AS (SELECT comment_id, max(is_abusive) AS gold FROM toxicity_labels WHERE is_abusive IS NOT NULL GROUP BY 1) SELECT CASE WHEN p IS NULL THEN 'missing' WHEN (p >= 0.7)::INT = gold THEN 'match' ELSE 'mismatch' END AS status, count(*) AS n FROM g LEFT JOIN s USING (comment_id) GROUP BY 1")
def prediction_status(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a matching, another or no prediction."""
    s = table(spark, sf, "toxicity_scores").where("was_successfully_labeled AND prob_toxic BETWEEN 0 AND 1").groupBy("comment_id").agg(F.max("prob_toxic").alias("p"))
    g = table(spark, sf, "toxicity_labels").where("is_abusive IS NOT NULL").groupBy("comment_id").agg(F.max("is_abusive").alias("gold"))
    status = F.when(F.col("p").isNull(), "missing").when((F.col("p") >= 0.7).cast("int") == F.col("gold"), "match").otherwise("mismatch")
    return g.join(s, "comment_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("flat_features", "SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY feature_id) - 1)::INT AS place, cluster_id || '_' || (row_number() OVER (PARTITION BY cluster_id ORDER BY feature_id) - 1) AS flat_id, feature_name FROM assignments_hdbscan WHERE cluster_id >= 0")
def flat_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features of each batch under its number and their place in it."""
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id >= 0").select("cluster_id", "feature_id", "feature_name")
    flat = ranks.ranked(a, ["cluster_id"], ["feature_id"], "place").withColumn("place", (F.col("place") - 1).cast("int"))
    return flat.select("cluster_id", "place", F.concat_ws("_", "cluster_id", "place").alias("flat_id"), "feature_name")


@query("feature_corpus", "SELECT cluster_id, count(DISTINCT category || ':' || feature_name || '=' || feature_value) AS n, sha256(string_agg(DISTINCT category || ':' || feature_name || '=' || feature_value, '|' ORDER BY category || ':' || feature_name || '=' || feature_value)) AS line_hash FROM assignments_hdbscan WHERE cluster_id >= 0 AND category IS NOT NULL AND feature_name IS NOT NULL AND feature_value IS NOT NULL GROUP BY 1")
def feature_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct features of each cluster in one line, by its hash."""
    a = table(spark, sf, "assignments_hdbscan").where("cluster_id >= 0 AND category IS NOT NULL AND feature_name IS NOT NULL AND feature_value IS NOT NULL")
    lines = F.array_sort(F.collect_set(F.concat("category", F.lit(":"), "feature_name", F.lit("="), "feature_value")))
    return a.groupBy("cluster_id").agg(lines.alias("x")).select("cluster_id", F.size("x").cast("long").alias("n"), F.sha2(F.array_join("x", "|"), 256).alias("line_hash"))


@query("topic_labels", f"SELECT cluster_id, coalesce(nullif(trim(max(CASE WHEN length(evidence_span) > 30 THEN evidence_span END), {SPACE}), ''), nullif(trim(min(feature_name), {SPACE}), ''), 'topic ' || cluster_id) AS label, count(*) AS n FROM assignments_hdbscan WHERE cluster_id IS NOT NULL AND cluster_id != -1 GROUP BY 1 ORDER BY n DESC, cluster_id LIMIT 15")
def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The fifteen largest clusters but noise, under the first label that there is."""
    blank = lambda c: F.nullif(keys.stripped(c), F.lit(""))
    label = F.coalesce(blank(F.max(F.when(F.length("evidence_span") > 30, F.col("evidence_span")))), blank(F.min("feature_name")), F.concat(F.lit("topic "), F.col("cluster_id")))
    return table(spark, sf, "assignments_hdbscan").where("cluster_id != -1").groupBy("cluster_id").agg(label.alias("label"), F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(15)


@query("cluster_exemplars", "WITH e AS (SELECT cluster_id, avg((rationale IS NULL)::INT) > (SELECT avg((rationale IS NULL)::INT) FROM assignments_hdbscan) AS high FROM assignments_hdbscan GROUP BY 1), r AS (SELECT a.cluster_id, feature_id, high, row_number() OVER (PARTITION BY a.cluster_id ORDER BY CASE WHEN high THEN -length(coalesce(feature_value, '')) ELSE length(coalesce(feature_value, '')) END, feature_id) AS rank FROM assignments_hdbscan a JOIN e USING (cluster_id) WHERE a.cluster_id >= 0) SELECT * FROM r WHERE rank <= 5")
def cluster_exemplars(spark: SparkSession, sf: str) -> DataFrame:
    """Five members of each cluster: the longest where errors are frequent, else the shortest."""
    a = table(spark, sf, "assignments_hdbscan")
    base = a.agg(F.avg(F.col("rationale").isNull().cast("int")).alias("base"))
    e = a.groupBy("cluster_id").agg(F.avg(F.col("rationale").isNull().cast("int")).alias("own")).join(F.broadcast(base), F.lit(True)).select("cluster_id", (F.col("own") > F.col("base")).alias("high"))  # base is one row
    size = F.length(F.coalesce("feature_value", F.lit("")))
    d = a.where("cluster_id >= 0").join(e, "cluster_id").select("cluster_id", "feature_id", "high", F.when(F.col("high"), -size).otherwise(size).alias("s"))
    return windows.top_per_group(d, ["cluster_id"], [F.asc("s"), F.asc("feature_id")], 5).drop("s")


def _vector_sql(op: str) -> str:
    return f"SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: abs({op}))), 4) AS total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _next(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")


def _total(c: Column) -> Column:
    return F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x)), 4).alias("total")


@query("vector_differences", _vector_sql("x[1]::DOUBLE - x[2]::DOUBLE"))
def vector_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Size of the difference of each vector and the next."""
    return _next(spark, sf).select("vec_id", _total(vectors.difference("embedding", "other")))


@query("unit_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS total FROM embeddings")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of the parts of each vector at length 1."""
    return table(spark, sf, "embeddings").select("vec_id", _total(vectors.unit("embedding")))


@query("vector_twins", "SELECT a.vec_id, len(list_filter(list_zip(a.embedding, b.embedding), lambda x: abs(x[1]::DOUBLE - x[2]::DOUBLE) > 1.0)) = 0 AS near FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_twins(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each vector and the next are equal within 1 everywhere."""
    return _next(spark, sf).select("vec_id", vectors.equivalent("embedding", "other", 1.0).alias("near"))


@query("cosine_histogram", "WITH c AS (SELECT list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), n AS (SELECT least(8, floor((c + 1) / 0.25)::INT + 1) AS bin, count(*) AS n FROM c WHERE c BETWEEN -1 AND 1 GROUP BY 1) SELECT bin, n, round(n / (sum(n) OVER () * 0.25), 6) AS density FROM n")
def cosine_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Cosines of neighbours over -1..1 in eight bins, as counts and density."""
    c = _next(spark, sf).select(vectors.cosine("embedding", "other").alias("c"))
    return vectors.density(c, "c", -1.0, 1.0, 8)
