"""Text measures, hashes, tokens and lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import text
from quorate.operators import aggregate, ranks, windows
from quorate.plans.common import table
from quorate.plans.registry import query

_W, _P = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_\s]"


def _sql(c: str) -> dict[str, str]:
    t = f"coalesce({c}, '')"
    words = f"len(regexp_extract_all({t}, '{_W}'))"
    ends = f"len(list_filter(regexp_split_to_array({t}, '[.!?]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') != ''))"
    marks = f"len(regexp_extract_all({t}, '{_P}'))"
    return {
        "char_count": f"length({t})",
        "word_count": words,
        "sentence_count": ends,
        "average_sentence_length": f"CASE WHEN {ends} > 0 THEN {words} / {ends} ELSE 0.0 END",
        "punctuation_count": marks,
        "punctuation_density": f"CASE WHEN length({t}) > 0 THEN {marks} / length({t}) ELSE 0.0 END",
    }


BASIC = list(_sql("x"))


@query("text_measures", "SELECT flip_id, " + ", ".join(f"round({e}, 6) AS {n}" for n, e in _sql("original_text").items()) + " FROM flips")
def text_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Six measures of every original text."""
    return table(spark, sf, "flips").select("flip_id", *[F.round(text.measure(n, "original_text").cast("double"), 6).alias(n) for n in BASIC])


@query("pair_measures", "SELECT flip_id, " + ", ".join(f"round(({a})::DOUBLE, 6) AS original_{n}, round(({b})::DOUBLE, 6) AS mirror_{n}, CASE WHEN ({a}) != 0 THEN round(({b}) / ({a}), 6) ELSE 0.0 END AS ratio_{n}" for (n, a), b in zip(_sql("original_text").items(), _sql("flipped_text").values(), strict=True) if n in ("char_count", "word_count")) + " FROM flips")
def pair_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of both texts of a pair and their ratio."""
    f = table(spark, sf, "flips")
    cols = [c for n in ("char_count", "word_count") for c in text.measure_triple(n, "original_text", "flipped_text")]
    wide = f.select("flip_id", *cols)
    return wide.select("flip_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in wide.columns[1:]])


_SYLLABLES = "list_sum(list_transform(w, lambda x: CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+')) - CASE WHEN regexp_replace(lower(x), '[^a-z]', '', 'g') LIKE '%e' AND len(regexp_extract_all(regexp_replace(lower(x), '[^a-z]', '', 'g'), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END))"


@query("readability", f"WITH x AS (SELECT message_id, regexp_extract_all(coalesce(original_text, ''), '\\p{{L}}+') AS w, greatest(1, {_sql('original_text')['sentence_count']}) AS s FROM four_cell_cohort), y AS (SELECT message_id, len(w) AS n, s, {_SYLLABLES} AS y FROM x) SELECT message_id, CASE WHEN n > 0 THEN round(0.39::DOUBLE * n / s + 11.8::DOUBLE * y / n - 15.59::DOUBLE, 6) ELSE 0.0 END AS grade, CASE WHEN n > 0 THEN round(206.835::DOUBLE - 1.015::DOUBLE * n / s - 84.6::DOUBLE * y / n, 6) ELSE 0.0 END AS reading_ease FROM y")
def readability(spark: SparkSession, sf: str) -> DataFrame:
    """Grade and reading ease of every cohort post."""
    return table(spark, sf, "four_cell_cohort").select("message_id", *[F.round(text.measure(n, "original_text"), 6).alias(n) for n in ("grade", "reading_ease")])


@query("length_parity", "WITH x AS (SELECT model_name, length(coalesce(original_text, '')) AS a, length(coalesce(flipped_text, '')) AS b FROM flips) SELECT model_name, count(*) AS n, round(avg((b < floor(0.9 * a) OR b > ceil(1.1 * a))::INT), 6) AS fail_share, round(avg((b > ceil(1.1 * a))::INT), 6) AS long_share, round(avg((b < floor(0.9 * a))::INT), 6) AS short_share, round(avg(CASE WHEN a > 0 THEN abs(b - a) / a END), 6) AS mean_difference FROM x GROUP BY 1")
def length_parity(spark: SparkSession, sf: str) -> DataFrame:
    """How often a flip is longer or shorter than a tenth beside its original, by model."""
    x = table(spark, sf, "flips").select("model_name", text.char_count("original_text").alias("a"), text.char_count("flipped_text").alias("b"))
    long, short = F.col("b") > F.ceil(F.col("a") * 1.1), F.col("b") < F.floor(F.col("a") * 0.9)
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    apart = F.when(F.col("a") > 0, F.abs(F.col("b") - F.col("a")) / F.col("a"))
    return x.groupBy("model_name").agg(F.count("*").alias("n"), share(long | short).alias("fail_share"), share(long).alias("long_share"), share(short).alias("short_share"), F.round(F.avg(apart), 6).alias("mean_difference"))


@query("text_hash_groups", "SELECT sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', E'\\n', 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), E' \\t\\n')) AS text_hash, count(*) AS n_rows, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def text_hash_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the same normalised text."""
    return table(spark, sf, "documents").groupBy(text.text_hash("text").alias("text_hash")).agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("first_id")).where("n_rows > 1")


_TOKENS = "WITH t AS (SELECT cell, message_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(original_text, '')), '[^a-z]+'), lambda w: length(w) > 1))) AS token FROM four_cell_cohort), n AS (SELECT cell, token, count(*) AS n_posts FROM t GROUP BY ALL)"


@query("top_tokens", _TOKENS + ", r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n_posts DESC, token) AS rank FROM n) SELECT cell, token, n_posts, rank FROM r WHERE rank <= 20")
def top_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty tokens of most posts, per cell."""
    t = table(spark, sf, "four_cell_cohort").select("cell", F.explode(text.tokens("original_text")).alias("token"))
    n = t.groupBy("cell", "token").agg(F.count("*").alias("n_posts"))
    return windows.top_per_group(n, ["cell"], [F.desc("n_posts"), F.asc("token")], 20)


@query("token_enrichment", _TOKENS + ", w AS (SELECT token, sum(n_posts) FILTER (WHERE cell = 'unanimous_remove') AS a, sum(n_posts) FILTER (WHERE cell = 'unanimous_keep') AS b FROM n GROUP BY 1), c AS (SELECT count(*) FILTER (WHERE cell = 'unanimous_remove') AS na, count(*) FILTER (WHERE cell = 'unanimous_keep') AS nb FROM four_cell_cohort) SELECT token, coalesce(a, 0)::BIGINT AS n_remove, coalesce(b, 0)::BIGINT AS n_keep, round(((coalesce(a, 0) + 0.5) / (na + 1e-9)) / ((coalesce(b, 0) + 0.5) / (nb + 1e-9)), 6) AS ratio FROM w, c WHERE a IS NOT NULL OR b IS NOT NULL")
def token_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """How much more often a token is in posts removed by all than in posts kept by all."""
    f = table(spark, sf, "four_cell_cohort")
    n = f.agg(F.count_if(F.col("cell") == "unanimous_remove").alias("a"), F.count_if(F.col("cell") == "unanimous_keep").alias("b")).first()
    t = f.where(F.col("cell").isin("unanimous_remove", "unanimous_keep")).select("cell", F.explode(text.tokens("original_text")).alias("token"))
    c = t.groupBy("token").agg(F.count_if(F.col("cell") == "unanimous_remove").alias("n_remove"), F.count_if(F.col("cell") == "unanimous_keep").alias("n_keep"))
    return aggregate.enrichment(c, "token", "n_remove", "n_keep", n["a"], n["b"])


@query("long_texts", "SELECT source, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(median(length(text)), 6) AS median_chars, max(length(text)) AS max_chars, count(*) FILTER (WHERE length(text) != n_chars) AS n_wrong FROM documents GROUP BY 1")
def long_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths of documents by source, and how many contradict their recorded length."""
    size = F.length("text")
    d = table(spark, sf, "documents")
    n = d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(size), 6).alias("mean_chars"), F.max(size).alias("max_chars"), F.count_if(size != F.col("n_chars")).alias("n_wrong"))
    m = ranks.quantiles(d.withColumn("size", size), ["source"], "size", {"m": 0.5}).withColumnRenamed("source", "s")
    return n.join(m, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "mean_chars", F.round("m", 6).alias("median_chars"), "max_chars", "n_wrong")
