"""Classifiers, calibration, scaling, reduction and clustering of feature rows, by the distributed trainers of Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibrated(fit: DataFrame, df: DataFrame, gold: str, score: str, method: str) -> DataFrame:
    """``df`` with ``score`` recalibrated on ``fit``: ``sigmoid`` (Platt) or ``isotonic`` (clipped to the fitted range)."""
    names = df.columns
    rows = lambda d: d.withColumn("__x", array_to_vector(F.array(F.col(score).cast("double")))).withColumn("__y", F.col(gold).cast("double"))
    if method == "sigmoid":
        model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", rawPredictionCol="__r", predictionCol="__z", standardization=False).fit(rows(fit))
        new = F.element_at(vector_to_array("__p"), 2)
    elif method == "isotonic":
        model = IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol="__z").fit(rows(fit))
        new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__z")))
    else:
        raise ValueError(f"unknown calibration {method}; there are sigmoid and isotonic")
    return model.transform(rows(df)).withColumn("__new", new).select(*[F.col("__new").alias(c) if c == score else F.col(c) for c in names])


def matrix(train: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), vectors: Sequence[str] = ()) -> Pipeline:
    """Stages that lay numbers (null as 0), one-hot categories (unknown ones as none) and array columns into ``features``."""
    stages = []
    for c in categories:
        stages.append(StringIndexer(inputCol=f"__c_{c}", outputCol=f"__i_{c}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", dropLast=True))
    stages.append(VectorAssembler(inputCols=[*[f"__n_{c}" for c in numbers], *[f"__o_{c}" for c in categories], *[f"__v_{c}" for c in vectors]], outputCol="features"))
    return Pipeline(stages=stages).fit(prepared(train, numbers, categories, vectors))


def prepared(df: DataFrame, numbers: Sequence[str], categories: Sequence[str] = (), vectors: Sequence[str] = ()) -> DataFrame:
    """Adds the columns that :func:`matrix` reads: numbers coerced, null as 0; categories, null and blank as ``none``; arrays as vectors."""
    named = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("none"))
    return df.withColumns({f"__c_{c}": named(c) for c in categories} | {f"__n_{c}": F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0)) for c in numbers} | {f"__v_{c}": array_to_vector(c) for c in vectors})


def logistic(train: DataFrame, label: str = "label", c: float = 1.0, balanced: bool = False, rounds: int = 2000):
    """A logistic regression on ``features`` with the penalty 1 / (n c); with ``balanced`` classes weigh the same in all."""
    n = {r["y"]: r["n"] for r in train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}  # two rows
    total = sum(n.values())
    if len(n) < 2:
        raise ValueError(f"one class only: {n}")
    weight = F.when(F.col(label) == 1, total / (2 * n[1])).otherwise(total / (2 * n[0])) if balanced else F.lit(1.0)
    model = LogisticRegression(labelCol="__y", weightCol="__w", maxIter=rounds, regParam=1.0 / (total * c), standardization=False)
    return model.fit(train.withColumn("__y", F.col(label).cast("double")).withColumn("__w", weight.cast("double")))


def boosted(train: DataFrame, label: str = "label", trees: int = 50, depth: int = 6, step: float = 0.05, share: float = 0.9, seed: int = 42):
    """Boosted trees on ``features``; the rarer class weighs more by the ratio of the classes."""
    n = {r["y"]: r["n"] for r in train.groupBy(F.col(label).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col(label) == 1, n.get(0, 1) / max(1, n.get(1, 1))).otherwise(1.0)
    model = GBTClassifier(labelCol="__y", weightCol="__w", maxIter=trees, maxDepth=depth, stepSize=step, subsamplingRate=share, seed=seed)
    return model.fit(train.withColumn("__y", F.col(label).cast("double")).withColumn("__w", weight.cast("double")))


def scores(model, df: DataFrame, name: str = "score") -> DataFrame:
    """``df`` with the model's probability of 1."""
    return model.transform(df).withColumn(name, F.element_at(vector_to_array("probability"), 2)).drop("rawPrediction", "probability", "prediction")


def coefficients(model, names: Sequence[str], n: int = 20) -> list[tuple[str, float]]:
    """The ``n`` features of largest weight, with it."""
    weights = list(zip(names, (float(w) for w in model.coefficients.toArray()), strict=True))
    return sorted(weights, key=lambda x: (-abs(x[1]), x[0]))[:n]


def standardised(train: DataFrame, df: DataFrame, column: str = "features", name: str = "scaled") -> DataFrame:
    """``df`` with ``name``: the vector by the mean and population deviation of ``train``; a constant dimension becomes 0."""
    n = train.count()
    model = StandardScaler(inputCol=column, outputCol="__s", withMean=True, withStd=True).fit(train)
    # The scaler divides by the sample deviation.
    factor = (n / max(1, n - 1)) ** 0.5
    return model.transform(df).withColumn(name, array_to_vector(F.transform(vector_to_array("__s"), lambda x: x * factor))).drop("__s")


def reduced(train: DataFrame, df: DataFrame, column: str, name: str, target: float = 0.5, least: int = 10, most: int = 20) -> tuple[DataFrame, list[float]]:
    """``df`` with ``name``: as many principal components as explain ``target`` of the variance, but between ``least`` and ``most``; and their shares.

    Each component's sign is such that its largest weight is positive.
    """
    size = train.select(F.size(vector_to_array(column)).alias("d")).first()["d"]
    most = min(most, size)
    model = PCA(k=most, inputCol=column, outputCol="__p").fit(train)
    shares = [float(x) for x in model.explainedVariance.toArray()]
    k = next((i + 1 for i in range(most) if sum(shares[: i + 1]) >= target), most)
    k = max(min(least, most), min(k, most))
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])[:k]
    mean = train.select(Summarizer.mean(F.col(column)).alias("m")).first()["m"].toArray()
    shift = (mean @ axes)[:k]
    out = F.transform(F.slice(vector_to_array("__p"), 1, k), lambda x, i: (x - F.get(F.array(*[F.lit(float(s)) for s in shift]), i)) * F.get(F.array(*[F.lit(float(s)) for s in signs]), i))
    return model.transform(df).withColumn(name, array_to_vector(out)).drop("__p"), shares[:k]


def discriminant(train: DataFrame, df: DataFrame, column: str, label: str, name: str, shrink: float = 1e-3) -> DataFrame:
    """``df`` with ``name``: its place along the linear discriminant of two classes.

    Means and covariances are sums over all rows; only d x d numbers reach the driver.
    """
    v = train.select(F.col(label).cast("int").alias("y"), vector_to_array(column).alias("v"))
    size = v.select(F.size("v").alias("d")).first()["d"]
    sums = v.groupBy("y").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(size)], *[F.sum(F.get("v", F.lit(i)) * F.get("v", F.lit(j))).alias(f"q{i}_{j}") for i in range(size) for j in range(i, size)]).collect()  # two rows
    within, means, total = np.zeros((size, size)), {}, 0
    for r in sums:
        m = np.array([r[f"s{i}"] for i in range(size)]) / r["n"]
        q = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        within += q - r["n"] * np.outer(m, m)
        means[r["y"]], total = m, total + r["n"]
    within = within / max(1, total - 2)
    axis = np.linalg.solve(within + shrink * np.trace(within) / size * np.eye(size), means[1] - means[0])
    axis /= np.linalg.norm(axis)
    return df.withColumn(name, F.aggregate(F.zip_with(vector_to_array(column), F.array(*[F.lit(float(a)) for a in axis]), lambda x, a: x * a), F.lit(0.0), lambda s, x: s + x))


def k_means(df: DataFrame, column: str, k: int, seeds: Sequence[int] = (0, 1, 2)) -> tuple[DataFrame, float]:
    """``df`` with ``cluster`` of the best of several starts, and its cost."""
    best = min((KMeans(k=k, seed=s, featuresCol=column, predictionCol="cluster", maxIter=50).fit(df) for s in seeds), key=lambda m: m.summary.trainingCost)
    return best.transform(df), float(best.summary.trainingCost)


def k_means_by_silhouette(df: DataFrame, column: str, ks: Sequence[int], seeds: Sequence[int] = (0, 1, 2)) -> tuple[DataFrame, int, dict[int, float]]:
    """The clustering of best silhouette (the smallest k of equals), its k, and the silhouette of every k."""
    found, judge = {}, ClusteringEvaluator(featuresCol=column, predictionCol="cluster")
    for k in ks:
        clustered, _ = k_means(df, column, k, seeds)
        found[k] = (judge.evaluate(clustered), clustered)
    best = max(found, key=lambda k: (found[k][0], -k))
    return found[best][1], best, {k: v for k, (v, _) in found.items()}


def one_hot(column: str, values: Sequence[str]) -> list[Column]:
    """A 0/1 column for each value of training; other values and null have none."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"is_{v.replace('-', '_')}") for v in values]


def class_weights(terms: DataFrame, group: str, term: str) -> DataFrame:
    """Weight of each class's terms: share of the class's terms times log(1 + mean terms of a class / the term's count in all)."""
    n = terms.groupBy(group, term).agg(F.count("*").alias("tf"))
    own = n.groupBy(group).agg(F.sum("tf").alias("own"))  # one row per class
    mean = own.agg((F.sum("own") / F.count("*")).alias("a"))  # one row
    # As many rows as classes that have the term.
    d = n.withColumn("f", F.sum("tf").over(Window.partitionBy(term))).join(F.broadcast(mean), F.lit(True)).join(own, group)
    return d.select(group, term, (F.col("tf") / F.col("own") * F.log1p(F.col("a") / F.col("f"))).alias("weight"))
