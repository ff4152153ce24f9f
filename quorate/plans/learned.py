"""Features, models and clusterings of posts and vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.functions import lexicon, text
from quorate.operators import evaluate, learn, windows
from quorate.plans.common import table
from quorate.plans.registry import query
from quorate.plans.roles import MODELS
from quorate.plans.summaries import STOP


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("scaled_vectors", "WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), s AS (SELECT d, avg(x) AS m, stddev_pop(x) AS sd FROM l GROUP BY 1) SELECT vec_id, round(sum(abs((x - m) / sd)), 3) AS total FROM l JOIN s USING (d) GROUP BY 1")
def scaled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Sum of each vector's distances from the mean, in population deviations."""
    v = _vectors(spark, sf)
    return learn.standardised(v, v).select("vec_id", F.round(F.aggregate(vector_to_array("scaled"), F.lit(0.0), lambda s, x: s + F.abs(x)), 3).alias("total"))


@query("one_hot_rows", "SELECT flip_id, " + ", ".join(f"coalesce((model_name = '{m}')::INT, 0) AS is_{m.replace('-', '_')}" for m in MODELS) + ", coalesce(length(original_text), 0) AS n_chars FROM flips")
def one_hot_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Feature rows whose columns are those of training: a model that was not there has none."""
    f = table(spark, sf, "flips")
    return f.select("flip_id", *learn.one_hot("model_name", MODELS), F.coalesce(F.length("original_text"), F.lit(0)).alias("n_chars"))


@query("class_terms", "WITH t AS (SELECT category, unnest(list_filter(regexp_extract_all(lower(coalesce(feature_value, '')), '[a-z0-9_]+'), lambda w: length(w) > 1 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in STOP) + "], w))) AS term FROM assignments_hdbscan WHERE category IS NOT NULL), n AS (SELECT category, term, count(*) AS tf FROM t GROUP BY ALL), s AS (SELECT *, sum(tf) OVER (PARTITION BY term) AS f, sum(tf) OVER (PARTITION BY category) AS own, sum(tf) OVER () / (SELECT count(DISTINCT category) FROM n) AS a FROM n), w AS (SELECT category, term, round(tf / own * ln(1 + a / f), 8) AS weight FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY weight DESC, term) AS rank FROM w) SELECT * FROM r WHERE rank <= 10")
def class_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The ten terms that tell each category from the others, by class-wise term weights."""
    a = table(spark, sf, "assignments_hdbscan").where("category IS NOT NULL")
    t = a.select("category", F.explode(text.terms("feature_value", STOP)).alias("term"))
    w = learn.class_weights(t, "category", "term").withColumn("weight", F.round("weight", 8))
    return windows.top_per_group(w, ["category"], [F.desc("weight"), F.asc("term")], 10)


@query("label_model")
def label_model(spark: SparkSession, sf: str) -> DataFrame:
    """Measures of a balanced logistic probe for removal, on text measures and labels of the posts held out."""
    numbers = ["chars", "words", "marks"]
    c = table(spark, sf, "four_cell_cohort").select("message_id", F.col("cell").endswith("remove").cast("int").alias("label"), text.char_count("original_text").alias("chars"), text.word_count("original_text").alias("words"), text.punctuation_count("original_text").alias("marks"), F.lower("sampled_stance").alias("stance"), *[lexicon.classify(n, "original_text").cast("int").alias(n) for n in lexicon.CLASSIFIERS])
    names = [*numbers, *lexicon.CLASSIFIERS]
    held = F.pmod(F.xxhash64("message_id"), F.lit(5)) == 0
    stages = learn.matrix(c.where(~held), names, ["stance"])
    rows = stages.transform(learn.prepared(c, names, ["stance"]))
    scaled = learn.standardised(rows.where(~held), rows).drop("features").withColumnRenamed("scaled", "features")
    model = learn.logistic(scaled.where(~held), balanced=True)
    scored = learn.scores(model, scaled.where(held)).withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    return evaluate.confusion(scored, [], "label", "yhat")


@query("vector_components")
def vector_components(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors on the principal components that explain half of the variance, by their first two, and their split."""
    v = _vectors(spark, sf)
    d, shares = learn.reduced(v, v, "features", "pc")
    p = vector_to_array("pc")
    split = F.when(F.pmod("vec_id", F.lit(5)) == 0, "test").otherwise("train")
    return d.select("vec_id", F.round(F.get(p, F.lit(0)), 6).alias("x"), F.round(F.get(p, F.lit(1)), 6).alias("y"), F.lit(len(shares)).alias("n_components"), split.alias("split"))


@query("vector_clusters")
def vector_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the k-means clusters of best silhouette."""
    d, k, found = learn.k_means_by_silhouette(_vectors(spark, sf), "features", [2, 3, 4, 5])
    return d.groupBy("cluster").agg(F.count("*").alias("n"), F.lit(k).alias("k"), F.lit(round(found[k], 6)).alias("silhouette"))


@query("cluster_stability")
def cluster_stability(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement of three seeds' clusterings, by the adjusted Rand index of each pair."""
    v = _vectors(spark, sf)
    runs = {s: learn.k_means(v, "features", 4, [s])[0].select("vec_id", F.col("cluster").alias(f"c{s}")) for s in (1, 2, 3)}
    out = None
    for a, b in ((1, 2), (1, 3), (2, 3)):
        one = evaluate.adjusted_rand(runs[a].join(runs[b], "vec_id"), f"c{a}", f"c{b}").withColumn("pair", F.lit(f"{a}-{b}"))
        out = one if out is None else out.unionByName(one)
    return out


@query("vector_discriminant")
def vector_discriminant(spark: SparkSession, sf: str) -> DataFrame:
    """Effect size of the linear discriminant between even and odd labels, on the first components."""
    v = _vectors(spark, sf).withColumn("y", F.pmod("label", F.lit(2)))
    d, _ = learn.reduced(v, v, "features", "pc", least=10, most=10)
    d = learn.discriminant(d, d, "pc", "y", "ld")
    return evaluate.effect_size(d, F.col("y") == 1, "ld")
