"""Summaries of cells, answers, themes, lengths and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import lexicon, text
from quorate.functions.keys import folded, stripped, usable
from quorate.functions.truncate import cut, cut_pair
from quorate.operators import aggregate, ranks, windows
from quorate.plans.common import DECISIONS, SPACE, decisions, table
from quorate.plans.registry import query

CELLS = ["unanimous_keep", "majority_keep", "majority_remove", "unanimous_remove"]
_CELLS = ", ".join(f"('{c}')" for c in CELLS)


def removed() -> Column:
    return (F.col("decision") == "remove").cast("int")


@query("first_answers", f"SELECT participant_id, arg_min(lower(trim(gender, {SPACE})), trial_row_id) FILTER (WHERE lower(trim(gender, {SPACE})) NOT IN ('', 'nan')) AS gender, arg_min(lower(trim(education, {SPACE})), trial_row_id) FILTER (WHERE lower(trim(education, {SPACE})) NOT IN ('', 'nan')) AS education FROM trials WHERE participant_id IS NOT NULL GROUP BY 1")
def first_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The first usable answer of each participant, in row order."""
    first = lambda c: F.min_by(F.when(usable(c), folded(c)), F.when(usable(c), F.col("trial_row_id"))).alias(c)
    return table(spark, sf, "trials").where("participant_id IS NOT NULL").groupBy("participant_id").agg(first("gender"), first("education"))


_PEOPLE = f"p AS (SELECT participant_id, arg_min(lower(trim(party_group, {SPACE})), trial_row_id) FILTER (WHERE party_group IS NOT NULL) AS party, arg_min(replace(lower(trim(condition, {SPACE})), '-', '_'), trial_row_id) FILTER (WHERE condition IS NOT NULL) AS condition FROM trials WHERE participant_id IS NOT NULL GROUP BY 1)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """Participants with the first party and condition that their rows name, in one spelling."""
    t = table(spark, sf, "trials").where("participant_id IS NOT NULL")
    first = lambda c, form: F.min_by(F.when(F.col(c).isNotNull(), form), F.when(F.col(c).isNotNull(), F.col("trial_row_id")))
    return t.groupBy("participant_id").agg(first("party_group", folded("party_group")).alias("party"), first("condition", F.replace(folded("condition"), F.lit("-"), F.lit("_"))).alias("condition"))


@query("people_matrix", f"WITH {_PEOPLE} SELECT CASE WHEN grouping(party) = 1 THEN 'all' ELSE coalesce(party, '<NA>') END AS party, CASE WHEN grouping(condition) = 1 THEN 'all' ELSE coalesce(condition, '<NA>') END AS condition, count(*) AS n FROM p GROUP BY CUBE (p.party, p.condition)")
def people_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Participants by party and condition with both margins."""
    return aggregate.margins(people(spark, sf), ["party", "condition"])


@query("removal_matrix", f"WITH {DECISIONS}, x AS (SELECT lower(trim(sample_toxicity_type, {SPACE})) AS toxicity, party_group, (decision = 'remove')::INT AS r FROM d) SELECT toxicity, " + ", ".join(f"round(avg(r) FILTER (WHERE party_group = '{p}'), 6) AS mean_{p}, coalesce(sum(r) FILTER (WHERE party_group = '{p}'), 0)::BIGINT AS n_{p}" for p in ("democrat", "republican")) + " FROM x GROUP BY 1")
def removal_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Removal rate and number of removals by toxicity, one column a party."""
    d = decisions(spark, sf).select(folded("sample_toxicity_type").alias("toxicity"), "party_group", removed().alias("r"))
    cells = []
    for p in ("democrat", "republican"):
        own = F.when(F.col("party_group") == p, F.col("r"))
        cells += [F.round(F.avg(own), 6).alias(f"mean_{p}"), F.coalesce(F.sum(own), F.lit(0)).cast("long").alias(f"n_{p}")]
    return d.groupBy("toxicity").agg(*cells)


@query("toxicity_margins", f"WITH {DECISIONS}, x AS (SELECT lower(trim(sample_toxicity_type, {SPACE})) AS toxicity, decision FROM d) SELECT CASE WHEN grouping(toxicity) = 1 THEN 'all' ELSE coalesce(toxicity, '<NA>') END AS toxicity, CASE WHEN grouping(decision) = 1 THEN 'all' ELSE coalesce(decision, '<NA>') END AS decision, count(*) AS n FROM x GROUP BY CUBE (x.toxicity, x.decision)")
def toxicity_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions by toxicity with both margins."""
    return aggregate.margins(decisions(spark, sf).select(folded("sample_toxicity_type").alias("toxicity"), "decision"), ["toxicity", "decision"])


_METRICS = ["char_count", "word_count", "punctuation_count"]


@query("partition_metrics", f"""WITH {DECISIONS}, x AS (SELECT party_group, condition, TRY_CAST(TRY_CAST(trim(phase, {SPACE}) AS DOUBLE) AS INT) AS phase, decision, length(coalesce(original_text, '')) AS char_count, len(regexp_extract_all(coalesce(original_text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS word_count, len(regexp_extract_all(coalesce(original_text, ''), '[^\\p{{L}}\\p{{N}}_\\s]')) AS punctuation_count FROM d)
SELECT party_group, condition, phase, decision, count(*) AS pair_count, {", ".join(f"round(avg({m}), 6) AS mean_{m}" for m in _METRICS)} FROM x WHERE phase IS NOT NULL GROUP BY party_group, condition, phase, decision
UNION ALL SELECT party_group, condition, NULL, decision, count(*), {", ".join(f"round(avg({m}), 6)" for m in _METRICS)} FROM x GROUP BY GROUPING SETS ((party_group, condition, decision), (party_group, decision), (condition, decision), (decision))""")
def partition_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Means of all text measures by party, condition, phase and decision, and over their coarser sets. Rows without phase are in the coarser ones only."""
    x = decisions(spark, sf).select("party_group", "condition", stripped("phase").try_cast("double").cast("int").alias("phase"), "decision", *[text.measure(m, "original_text").alias(m) for m in _METRICS])
    means = [F.count("*").alias("pair_count"), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in _METRICS]]
    p, c, d = F.col("party_group"), F.col("condition"), F.col("decision")
    fine = x.where("phase IS NOT NULL").groupBy("party_group", "condition", "phase", "decision").agg(*means)
    coarse = x.groupingSets([[p, c, d], [p, d], [c, d], [d]], p, c, d).agg(*means).withColumn("phase", F.lit(None).cast("int"))
    return fine.unionByName(coarse)


@query("decision_buckets", f"SELECT CASE WHEN lower(trim(decision, {SPACE})) IN ('keep', 'remove') THEN lower(trim(decision, {SPACE})) WHEN coalesce(lower(trim(decision, {SPACE})) NOT IN ('', 'nan'), false) THEN 'no_keep_remove_rows' ELSE 'missing' END AS bucket, count(*) AS n FROM trials GROUP BY 1")
def decision_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Trials by decision, with a bucket for other decisions and one for none."""
    d = folded("decision")
    bucket = F.when(d.isin("keep", "remove"), d).when(usable("decision"), "no_keep_remove_rows").otherwise("missing")
    return table(spark, sf, "trials").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


_LABELS = {n: f"regexp_matches(lower(coalesce(original_text, '')), '\\b(?:{w})\\b')::INT" for n, w in lexicon.CLASSIFIERS.items()}


@query("positive_rates", f"WITH {DECISIONS} SELECT party_group, condition, phase, decision, count(*) AS n, " + ", ".join(f"round(avg({e}), 6) AS {n}" for n, e in _LABELS.items()) + " FROM d GROUP BY ALL")
def positive_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of texts under each classifier by party, condition, phase and decision; null keys are groups."""
    d = decisions(spark, sf)
    return d.groupBy("party_group", "condition", "phase", "decision").agg(F.count("*").alias("n"), *[F.round(F.avg(lexicon.classify(n, "original_text").cast("int")), 6).alias(n) for n in lexicon.CLASSIFIERS])


@query("cell_summary", f"WITH x AS (SELECT cell, (lower(trim(sample_toxicity_type, {SPACE})) = 'sample_high_toxicity')::INT AS high, length(coalesce(original_text, '')) AS char_count, len(regexp_extract_all(coalesce(original_text, ''), '[\\p{{L}}\\p{{N}}_]+')) AS word_count, {', '.join(f'{e} AS {n}' for n, e in _LABELS.items())} FROM four_cell_cohort), s AS (SELECT cell, count(*) AS n, round(sum(high) / count(*), 6) AS high_share, round(median(char_count), 6) AS char_count, round(median(word_count), 6) AS word_count, {', '.join(f'round(avg({n}), 6) AS {n}' for n in _LABELS)} FROM x GROUP BY 1) SELECT c.cell, coalesce(n, 0) AS n, coalesce(high_share, 0.0) AS high_share, char_count, word_count, {', '.join(_LABELS)} FROM (VALUES {_CELLS}) c(cell) LEFT JOIN s USING (cell)")
def cell_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Size, share of high toxicity, medians of measures and shares of labels of each cell; a cell without posts has 0 and nulls."""
    x = table(spark, sf, "four_cell_cohort").select("cell", F.coalesce((folded("sample_toxicity_type") == "sample_high_toxicity").cast("int"), F.lit(0)).alias("high"), text.char_count("original_text").alias("char_count"), text.word_count("original_text").alias("word_count"), *[lexicon.classify(n, "original_text").cast("int").alias(n) for n in lexicon.CLASSIFIERS])
    s = x.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("high"), 6).alias("high_share"), *[F.round(F.avg(n), 6).alias(n) for n in lexicon.CLASSIFIERS])
    for m in ("char_count", "word_count"):
        s = s.join(ranks.quantiles(x, ["cell"], m, {m: 0.5}).withColumn(m, F.round(m, 6)), "cell", "left")
    cells = spark.createDataFrame([(c,) for c in CELLS], "cell string")
    return cells.join(s, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("high_share", F.lit(0.0)).alias("high_share"), "char_count", "word_count", *lexicon.CLASSIFIERS)


@query("stance_cells", f"SELECT lower(trim(sample_toxicity_type, {SPACE})) AS toxicity, lower(trim(sampled_stance, {SPACE})) AS stance, " + ", ".join(f"count(*) FILTER (WHERE cell = '{c}') AS n_{c}" for c in CELLS) + ", count(*) AS n_total FROM four_cell_cohort GROUP BY ALL")
def stance_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Posts by toxicity and stance, one column a cell."""
    d = table(spark, sf, "four_cell_cohort").select(folded("sample_toxicity_type").alias("toxicity"), folded("sampled_stance").alias("stance"), "cell")
    return d.groupBy("toxicity", "stance").agg(*[F.count_if(F.col("cell") == c).alias(f"n_{c}") for c in CELLS], F.count("*").alias("n_total"))


@query("stance_cells_long", f"WITH n AS (SELECT coalesce(lower(trim(sample_toxicity_type, {SPACE})), '<NA>') AS toxicity, coalesce(lower(trim(sampled_stance, {SPACE})), '<NA>') AS stance, cell, count(*) AS n FROM four_cell_cohort GROUP BY ALL), g AS (SELECT DISTINCT toxicity, stance FROM n) SELECT g.toxicity, g.stance, c.cell, coalesce(n.n, 0) AS n FROM g, (VALUES {_CELLS}) c(cell) LEFT JOIN n ON n.toxicity = g.toxicity AND n.stance = g.stance AND n.cell = c.cell")
def stance_cells_long(spark: SparkSession, sf: str) -> DataFrame:
    """The same, one row a cell, also the empty ones."""
    d = table(spark, sf, "four_cell_cohort").select(F.coalesce(folded("sample_toxicity_type"), F.lit("<NA>")).alias("toxicity"), F.coalesce(folded("sampled_stance"), F.lit("<NA>")).alias("stance"), "cell")
    wide = d.groupBy("toxicity", "stance").agg(*[F.count_if(F.col("cell") == c).alias(c) for c in CELLS])
    return wide.unpivot(["toxicity", "stance"], CELLS, "cell", "n")


@query("distribution_extremes", f"WITH n AS (SELECT CASE WHEN lower(trim(sample_toxicity_type, {SPACE})) NOT IN ('', 'nan') THEN lower(trim(sample_toxicity_type, {SPACE})) ELSE '<NA>' END AS category, count(*) AS n FROM four_cell_cohort GROUP BY 1) SELECT count(*) AS n_categories, round(max(n) / sum(n), 6) AS max_share, round(min(n) / sum(n), 6) AS min_share, round(max(n) / min(n), 6) AS ratio FROM n")
def distribution_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Largest and smallest share of the toxicity categories, and their ratio."""
    c = F.when(usable("sample_toxicity_type"), folded("sample_toxicity_type")).otherwise("<NA>")
    n = table(spark, sf, "four_cell_cohort").groupBy(c.alias("category")).agg(F.count("*").alias("n"))
    share = lambda x: F.round(F.try_divide(x, F.sum("n")), 6)
    return n.agg(F.count("*").alias("n_categories"), share(F.max("n")).alias("max_share"), share(F.min("n")).alias("min_share"), F.round(F.when(F.min("n") > 0, F.max("n") / F.min("n")).otherwise(F.lit(float("inf"))), 6).alias("ratio"))


_ANSWERS = f"a AS (SELECT participant_id, lower(trim(party_group, {SPACE})) AS party, replace(lower(trim(condition, {SPACE})), '-', '_') AS condition, trim(phase1_pair_reflection_text, {SPACE}) AS answer, TRY_CAST(trim(phase1_pair_influence_rating, {SPACE}) AS DOUBLE) AS rating FROM trials WHERE coalesce(lower(trim(phase1_pair_reflection_text, {SPACE})) NOT IN ('', 'nan'), false) AND TRY_CAST(trim(phase1_pair_influence_rating, {SPACE}) AS DOUBLE) IS NOT NULL AND NOT isnan(TRY_CAST(trim(phase1_pair_influence_rating, {SPACE}) AS DOUBLE)))"
_A_WORDS = "len(regexp_extract_all(lower(answer), '\\b[a-z][a-z'']+\\b'))"


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """Free answers with a number for their rating."""
    rating = stripped("phase1_pair_influence_rating").try_cast("double")
    t = table(spark, sf, "trials").where(usable("phase1_pair_reflection_text")).withColumn("rating", rating).where("rating IS NOT NULL AND NOT isnan(rating)")
    return t.select("participant_id", folded("party_group").alias("party"), F.replace(folded("condition"), F.lit("-"), F.lit("_")).alias("condition"), stripped("phase1_pair_reflection_text").alias("answer"), "rating")


def answer_words(c: str = "answer") -> Column:
    return F.regexp_count(F.lower(c), F.lit(r"\b[a-z][a-z']+\b"))


@query("answer_features", f"WITH {_ANSWERS} SELECT participant_id, condition, length(answer) AS n_chars, {_A_WORDS} AS n_words, len(list_filter(regexp_split_to_array(answer, '[.!?]+'), lambda s: regexp_replace(s, '\\s+', '', 'g') != '')) AS n_sentences, len(regexp_extract_all(answer, '\\?')) AS n_questions, len(regexp_extract_all(answer, '!')) AS n_exclamations, " + ", ".join(f"regexp_matches(lower(answer), '\\b(?:{w})\\b') AS {n}" for n, w in lexicon.THEMES.items()) + " FROM a")
def answer_features(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and themes of every free answer."""
    return answers(spark, sf).select("participant_id", "condition", F.length("answer").alias("n_chars"), answer_words().alias("n_words"), text.sentence_count("answer").alias("n_sentences"), F.regexp_count("answer", F.lit(r"\?")).alias("n_questions"), F.regexp_count("answer", F.lit("!")).alias("n_exclamations"), *[lexicon.mentions("answer", w).alias(n) for n, w in lexicon.THEMES.items()])


@query("answer_overview", f"WITH {_ANSWERS} SELECT count(*) AS n, count(DISTINCT participant_id) AS n_people, count(DISTINCT coalesce(party, '<NA>') || '|' || coalesce(condition, '<NA>')) AS n_groups, round(avg({_A_WORDS}), 6) AS mean_words, round(median({_A_WORDS}), 6) AS median_words, round(quantile_cont({_A_WORDS}, 0.75), 6) AS p75_words FROM a")
def answer_overview(spark: SparkSession, sf: str) -> DataFrame:
    """Answers, people and groups, and the spread of the answers' lengths."""
    a = answers(spark, sf).withColumn("w", answer_words()).withColumn("g", F.lit(0))
    na = lambda c: F.coalesce(c, F.lit("<NA>"))
    n = a.groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("participant_id").alias("n_people"), F.count_distinct(F.concat_ws("|", na("party"), na("condition"))).alias("n_groups"), F.round(F.avg("w"), 6).alias("mean_words"))
    q = ranks.quantiles(a, ["g"], "w", {"median_words": 0.5, "p75_words": 0.75})
    return n.join(q, "g").select("n", "n_people", "n_groups", "mean_words", F.round("median_words", 6).alias("median_words"), F.round("p75_words", 6).alias("p75_words"))


@query("rating_shares", f"WITH {_ANSWERS} SELECT party, condition, count(*) AS n, round(avg((rating BETWEEN 1 AND 3)::INT), 6) AS low_share, round(avg((rating = 4)::INT), 6) AS middle_share, round(avg((rating BETWEEN 5 AND 7)::INT), 6) AS high_share, round(1.96 * stddev_samp(rating) / sqrt(count(*)), 6) AS half_width FROM a GROUP BY ALL")
def rating_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of low, middle and high ratings per group, and the half-width of the mean's interval."""
    r = F.col("rating")
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    return answers(spark, sf).groupBy("party", "condition").agg(F.count("*").alias("n"), share(r.between(1, 3), "low_share"), share(r == 4, "middle_share"), share(r.between(5, 7), "high_share"), F.round(1.96 * F.stddev_samp(r) / F.sqrt(F.count("*")), 6).alias("half_width"))


@query("theme_rates", f"WITH {_ANSWERS} SELECT party, condition, count(*) AS n, " + ", ".join(f"round(avg(regexp_matches(lower(answer), '\\b(?:{w})\\b')::INT), 6) AS {n}" for n, w in lexicon.THEMES.items()) + " FROM a GROUP BY ALL")
def theme_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Share of answers that mention each theme, per group."""
    return answers(spark, sf).groupBy("party", "condition").agg(F.count("*").alias("n"), *[F.round(F.avg(lexicon.mentions("answer", w).cast("int")), 6).alias(n) for n, w in lexicon.THEMES.items()])


@query("theme_shares", f"WITH {_ANSWERS}, l AS (" + " UNION ALL ".join(f"SELECT condition, '{n}' AS theme, sum(regexp_matches(lower(answer), '\\b(?:{w})\\b')::INT) AS n FROM a GROUP BY 1" for n, w in lexicon.THEMES.items()) + ") SELECT condition, theme, n::BIGINT AS n, CASE WHEN sum(n) OVER (PARTITION BY condition) > 0 THEN round(n / sum(n) OVER (PARTITION BY condition), 6) ELSE 0.0 END AS share FROM l")
def theme_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Each theme's share of all mentions, per condition."""
    n = answers(spark, sf).groupBy("condition").agg(*[F.count_if(lexicon.mentions("answer", w)).alias(t) for t, w in lexicon.THEMES.items()])
    long = n.unpivot("condition", list(lexicon.THEMES), "theme", "n")
    return aggregate.with_proportion(long, ["condition"], name="share", digits=6).withColumn("share", F.coalesce("share", F.lit(0.0)))


@query("top_terms", f"WITH {_ANSWERS}, t AS (SELECT condition, unnest(regexp_extract_all(lower(answer), '\\b[a-z][a-z'']+\\b')) AS term FROM a), n AS (SELECT condition, term, count(*) AS n FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY n DESC, term) AS r FROM n) SELECT condition, string_agg(term, ', ' ORDER BY r) AS terms FROM r WHERE r <= 8 GROUP BY 1")
def top_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The eight most frequent terms of each condition, in one line."""
    t = answers(spark, sf).select("condition", F.explode(F.regexp_extract_all(F.lower("answer"), F.lit(r"(\b[a-z][a-z']+\b)"), 1)).alias("term"))
    n = t.groupBy("condition", "term").agg(F.count("*").alias("n"))
    top = windows.top_per_group(n, ["condition"], [F.desc("n"), F.asc("term")], 8, "r")
    return top.groupBy("condition").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("terms"))


@query("representative_answers", f"WITH {_ANSWERS}, w AS (SELECT *, {_A_WORDS} AS words FROM a), m AS (SELECT party, condition, median(words) AS m FROM w GROUP BY ALL), r AS (SELECT w.party, w.condition, participant_id, rating, words, row_number() OVER (PARTITION BY w.party, w.condition ORDER BY (rating >= 5)::INT DESC, CASE WHEN rating >= 5 THEN -rating ELSE 0 END, abs(words - m), participant_id, answer) AS r FROM w JOIN m ON w.party IS NOT DISTINCT FROM m.party AND w.condition IS NOT DISTINCT FROM m.condition) SELECT party, condition, participant_id, rating, words FROM r WHERE r = 1")
def representative_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer of each group: of high rating, and nearest to the group's median length; without high ones the nearest."""
    w = answers(spark, sf).withColumn("words", answer_words())
    m = ranks.quantiles(w, ["party", "condition"], "words", {"m": 0.5}).toDF("p", "c", "m")
    d = w.join(m, F.col("party").eqNullSafe(F.col("p")) & F.col("condition").eqNullSafe(F.col("c")))
    high = (F.col("rating") >= 5).cast("int")
    d = d.withColumns({"high": -high, "by": F.when(high == 1, -F.col("rating")).otherwise(0.0), "far": F.abs(F.col("words") - F.col("m"))})
    best = windows.first_per_key(d, ["party", "condition"], ["high", "by", "far", "participant_id", "answer"])
    return best.select("party", "condition", "participant_id", "rating", "words")


@query("length_parity_overall", "WITH x AS (SELECT length(coalesce(original_text, '')) AS a, length(coalesce(flipped_text, '')) AS b FROM flips) SELECT count(*) AS n, count(*) FILTER (WHERE a = 0) AS n_empty, round(avg((abs(b - a) / a >= 0.10)::INT) FILTER (WHERE a > 0), 6) AS share_apart FROM x")
def length_parity_overall(spark: SparkSession, sf: str) -> DataFrame:
    """Share of flips that are a tenth longer or shorter than their original, and originals without text."""
    a, b = text.char_count("original_text"), text.char_count("flipped_text")
    far = F.when(a > 0, (F.abs(b - a) / a >= 0.10).cast("int"))
    return table(spark, sf, "flips").agg(F.count("*").alias("n"), F.count_if(a == 0).alias("n_empty"), F.round(F.avg(far), 6).alias("share_apart"))


def _cut_sql(t: str, most: str, least: str) -> str:
    """Last place in the first ``most`` characters at which a text may be cut."""
    w = f"left({t}, {most})"
    last = lambda sign: f"(CASE WHEN contains({w}, {sign}) THEN {most} - strpos(reverse({w}), {sign}) + 1 ELSE 0 END)"
    line, space = f"{last('chr(10)')} - 1", f"{last(chr(39) + ' ' + chr(39))} - 1"
    clause = f"greatest({last(chr(39) + ';' + chr(39))}, {last(chr(39) + ':' + chr(39))})"
    ends = f"list_max(list_transform(list_filter(range(1, {most} + 1), lambda i: substr({w}, i, 1) IN ('.', '!', '?') AND (i = {most} OR regexp_matches(substr({w}, i + 1, 1), '\\s')) AND i > {least} AND NOT (substr({w}, i, 1) = '.' AND i > 1 AND substr({w}, i - 1, 1) = '.')), lambda i: i))"
    found = f"greatest(CASE WHEN {line} >= {least} THEN {line} ELSE 0 END, CASE WHEN {space} >= {least} THEN {space} ELSE 0 END, {clause}, coalesce({ends}, 0))"
    return f"CASE WHEN length({t}) <= {most} THEN {t} WHEN {found} > 0 THEN regexp_replace(left({w}, {found}), '\\s+$', '') ELSE regexp_replace({w}, '\\s+$', '') END"


_STRIP = "regexp_replace(regexp_replace(coalesce({0}, ''), '^\\s+', ''), '\\s+$', '')"
_TRUNCATED = f"s AS (SELECT flip_id, lower(trim(sampled_stance, {SPACE})) AS stance, {_STRIP.format('original_text')} AS a, {_STRIP.format('flipped_text')} AS b FROM flips), o AS (SELECT *, {_cut_sql('a', '100', '75')} AS a2 FROM s), m AS (SELECT *, length(a2) AS target, (length(a2) * 0.75)::DOUBLE AS x FROM o), t AS (SELECT flip_id, stance, a, b, a2, {_cut_sql('b', 'target', 'floor(x)::BIGINT')} AS b2 FROM m)"


def _truncated(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "flips").select("flip_id", folded("sampled_stance").alias("stance"), text.outer_stripped("original_text").alias("a"), text.outer_stripped("flipped_text").alias("b"))
    return cut_pair(f, "a", "b", "a2", "b2", 100)


@query("truncated_pairs", f"WITH {_TRUNCATED} SELECT flip_id, length(a2) AS original_chars, length(b2) AS flipped_chars, a != a2 AS original_cut, b != b2 AS flipped_cut, sha256(a2 || '|' || b2) AS texts FROM t")
def truncated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Originals cut at the last boundary within 100 characters, flips within the length of their cut original."""
    t = _truncated(spark, sf)
    return t.select("flip_id", F.length("a2").alias("original_chars"), F.length("b2").alias("flipped_chars"), (F.col("a") != F.col("a2")).alias("original_cut"), (F.col("b") != F.col("b2")).alias("flipped_cut"), F.sha2(F.concat_ws("|", "a2", "b2"), 256).alias("texts"))


@query("truncation_metrics", f"WITH {_TRUNCATED} SELECT CASE WHEN grouping(stance) = 1 THEN 'all' ELSE coalesce(stance, '<NA>') END AS stance, count(*) AS n, round(avg(length(a)), 6) AS original_before, round(avg(length(b)), 6) AS flipped_before, round(avg(length(a2)), 6) AS original_after, round(avg(length(b2)), 6) AS flipped_after, count(*) FILTER (WHERE length(a2) < 0.3 * least(length(a), 100)) AS original_lost, count(*) FILTER (WHERE length(b2) < 0.3 * least(length(b), 100)) AS flipped_lost FROM t GROUP BY ROLLUP (stance)")
def truncation_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths before and after truncation, and texts that lost nearly everything, by stance and over all."""
    n = {c: F.length(c) for c in ("a", "b", "a2", "b2")}
    mean = lambda c, name: F.round(F.avg(n[c]), 6).alias(name)
    lost = lambda before, after, name: F.count_if(n[after] < 0.3 * F.least(n[before], F.lit(100))).alias(name)
    r = _truncated(spark, sf).rollup("stance").agg(F.grouping("stance").alias("g"), F.count("*").alias("n"), mean("a", "original_before"), mean("b", "flipped_before"), mean("a2", "original_after"), mean("b2", "flipped_after"), lost("a", "a2", "original_lost"), lost("b", "b2", "flipped_lost"))
    return r.withColumn("stance", F.when(F.col("g") == 1, "all").otherwise(F.coalesce("stance", F.lit("<NA>")))).drop("g")


@query("truncated_sentences")
def truncated_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Texts cut to their longest complete sentence, and how many then end on one."""
    f = table(spark, sf, "flips").select(F.col("model_name"), F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("t")) for r, c in (("original", "original_text"), ("flipped", "flipped_text"))])).alias("x")).select("model_name", "x.role", "x.t")
    d = cut(f, "t", "s", 150)
    return d.groupBy("model_name", "role").agg(F.count("*").alias("n"), F.count_if("s.changed").alias("n_changed"), F.count_if("s.complete").alias("n_complete"), F.round(F.avg(F.length("s.text")), 6).alias("mean_chars"))


#: Words that carry no topic.
STOP = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "their", "they", "this", "to", "was", "we", "were", "with"]


@query("top_bigrams", "WITH t AS (SELECT cell, message_id, list_filter(regexp_extract_all(lower(coalesce(original_text, '')), '[a-z0-9_]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], w)) AS w FROM four_cell_cohort), g AS (SELECT cell, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t), n AS (SELECT cell, gram, count(*) AS n FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY n DESC, gram) AS rank FROM n) SELECT * FROM r WHERE rank <= 20")
def top_bigrams(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty most frequent bigrams of each cell."""
    d = table(spark, sf, "four_cell_cohort").select("cell", F.explode(text.grams(text.terms("original_text", STOP), 2)).alias("gram"))
    n = d.groupBy("cell", "gram").agg(F.count("*").alias("n"))
    return windows.top_per_group(n, ["cell"], [F.desc("n"), F.asc("gram")], 20)


#: Prices of a million tokens, in and out, and the share of cached input that is billed.
PRICES = {"mirror-small": (0.4, 1.6), "mirror-large": (2.0, 8.0), "mirror-large-v2": (2.5, 10.0)}
_PRICE = "CASE model_name " + " ".join(f"WHEN '{m}' THEN (i / 1e6 * {a}::DOUBLE + o / 1e6 * {b}::DOUBLE)" for m, (a, b) in PRICES.items()) + " END"


@query("call_costs", f"WITH c AS (SELECT post_primary_key, model_name, lower(trim(sampled_stance, {SPACE})) AS bucket, greatest(ceil(length(coalesce(original_text, '')) / 4) - 10, 0) AS i, ceil(length(coalesce(flipped_text, '')) / 4) AS o FROM flips QUALIFY row_number() OVER (PARTITION BY post_primary_key ORDER BY generated_at, flip_id) = 1) SELECT bucket, model_name, count(*) AS n_calls, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum({_PRICE}), 6) AS cost FROM c GROUP BY ALL")
def call_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Calls, tokens and cost by bucket and model; of the tries of one post the first counts, ten cached tokens are free."""
    f = table(spark, sf, "flips").select("post_primary_key", "generated_at", "flip_id", "model_name", folded("sampled_stance").alias("bucket"), F.greatest(F.ceil(text.char_count("original_text") / 4) - 10, F.lit(0)).alias("i"), F.ceil(text.char_count("flipped_text") / 4).alias("o"))
    first = windows.first_per_key(f, ["post_primary_key"], ["generated_at", "flip_id"])
    cost = F.lit(None).cast("double")
    for m, (a, b) in PRICES.items():
        cost = F.when(F.col("model_name") == m, F.col("i") / 1e6 * a + F.col("o") / 1e6 * b).otherwise(cost)
    return first.groupBy("bucket", "model_name").agg(F.count("*").alias("n_calls"), F.sum("i").alias("tokens_in"), F.sum("o").alias("tokens_out"), F.round(F.sum(cost), 6).alias("cost"))


@query("token_calibration", "WITH u AS (SELECT flip_id, length(flipped_text) / 4.0 AS estimated, len(regexp_extract_all(flipped_text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS actual FROM flips WHERE length(flipped_text) > 0 ORDER BY flip_id LIMIT 100) SELECT count(*) AS n, round(avg(actual / estimated), 6) AS factor FROM u")
def token_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of actual over estimated tokens, over the first hundred usable rows (the size of the calibration set)."""
    u = table(spark, sf, "flips").where(F.length("flipped_text") > 0).select("flip_id", (F.length("flipped_text") / 4.0).alias("e"), F.regexp_count("flipped_text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")).alias("a"))
    return u.orderBy("flip_id").limit(100).agg(F.count("*").alias("n"), F.round(F.avg(F.col("a") / F.col("e")), 6).alias("factor"))


@query("theme_counts", "WITH a AS (SELECT coalesce(cluster_id, -1) AS cluster_id, category, feature_id, feature_name, (evidence_span IS NOT NULL AND evidence_span != '') AS core FROM assignments_hdbscan) SELECT CASE WHEN cluster_id = -1 THEN 'residual' ELSE coalesce(category, 'other') END AS theme, count(*) AS n_features, count(DISTINCT feature_name) AS n_names, count(*) FILTER (WHERE core) AS n_core, count(*) FILTER (WHERE NOT core) AS n_soft FROM a GROUP BY 1")
def theme_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Features and names of each theme, with and without evidence; noise is the residual, unknown themes are other."""
    theme = F.when(F.coalesce("cluster_id", F.lit(-1)) == -1, "residual").otherwise(F.coalesce("category", F.lit("other")))
    core = F.coalesce(F.col("evidence_span") != "", F.lit(False))
    return table(spark, sf, "assignments_hdbscan").groupBy(theme.alias("theme")).agg(F.count("*").alias("n_features"), F.count_distinct("feature_name").alias("n_names"), F.count_if(core).alias("n_core"), F.count_if(~core).alias("n_soft"))
