"""Measures of classifiers: hard labels, thresholds, ranking, calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.operators.ranks import running_total


def confusion(df: DataFrame, by: Sequence[str], gold: str, predicted: Column | str) -> DataFrame:
    """tp, tn, fp, fn and accuracy, precision, recall, f1 per group; 0 where a measure is undefined."""
    g, p = F.col(gold) == 1, (F.col(predicted) if isinstance(predicted, str) else predicted) == 1
    n = df.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & ~p).alias("tn"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"))
    return with_measures(n)


def with_measures(n: DataFrame) -> DataFrame:
    """Adds the measures of columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    safe = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(F.lit(0.0)), 6)
    return n.withColumns({"accuracy": safe(tp + tn, tp + tn + fp + fn), "precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)})


def sweep(df: DataFrame, gold: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Measures at each threshold (predicted where score >= threshold).

    Scores are first counted between thresholds, so the thresholds meet a few
    hundred rows and not the data.
    """
    edges = F.array(*[F.lit(float(t)) for t in thresholds])
    place = F.size(F.filter(edges, lambda t: F.col(score) >= t))
    counts = df.groupBy(place.alias("place")).agg(F.count_if(F.col(gold) == 1).alias("pos"), F.count_if(F.col(gold) != 1).alias("neg"))
    above = F.col("place") > F.col("i")
    zero = F.lit(0)
    # Each of the counted rows meets each threshold: places x thresholds rows.
    met = counts.select("place", "pos", "neg", F.posexplode(edges).alias("i", "threshold"))
    n = met.groupBy("threshold").agg(*[F.sum(F.when(c, F.col(v)).otherwise(zero)).alias(a) for a, c, v in (("tp", above, "pos"), ("fp", above, "neg"), ("fn", ~above, "pos"), ("tn", ~above, "neg"))])
    return with_measures(n)


def ranking(df: DataFrame, gold: str, score: str) -> DataFrame:
    """Exact area under the ROC curve (ties at their average rank) and average precision, in one row.

    Null where a side has no rows. Rows are first counted by score; the running totals then run over distinct scores.
    """
    c = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(gold) == 1).alias("p"), F.count_if(F.col(gold) != 1).alias("q"))
    c = running_total(c.withColumn("down", -F.col("s")), ["down"], ["p", "q"], "c")
    # Positives above each negative, ties half.
    auc = F.try_divide(F.sum(F.col("q") * (F.col("cp") - F.col("p") / 2)), F.sum("p") * F.sum("q"))
    ap = F.try_divide(F.sum(F.col("p") * F.col("cp") / (F.col("cp") + F.col("cq"))), F.sum("p"))
    return c.agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.round(auc, 6).alias("roc_auc"), F.round(ap, 6).alias("average_precision"))


def calibration(df: DataFrame, gold: str, score: str, bins: int = 10) -> DataFrame:
    """Right-closed bins of the score: n, mean score, share of ones; a score of 0 is in no bin."""
    b = F.ceil(F.col(score) * bins).cast("int")
    return df.where((F.col(score) > 0) & (F.col(score) <= 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg(F.col(gold).cast("double")), 6).alias("share"))


def brier_ece(df: DataFrame, gold: str, score: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error, in one row."""
    b = F.when((F.col(score) > 0) & (F.col(score) <= 1), F.ceil(F.col(score) * bins).cast("int"))
    g = F.col(gold).cast("double")
    by = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum(score).alias("s"), F.sum(g).alias("g"), F.sum(F.pow(F.col(score) - g, F.lit(2.0))).alias("e"))
    gap = F.sum(F.when(F.col("bin").isNotNull(), F.abs(F.col("s") - F.col("g"))).otherwise(F.lit(0.0)))
    return by.agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("e"), F.sum("n")), 6).alias("brier"), F.round(F.try_divide(gap, F.sum("n")), 6).alias("ece"))


def lift(df: DataFrame, cluster: str, error: Column) -> DataFrame:
    """Size, error rate and lift over the global rate of each cluster."""
    by = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(error.cast("long")).alias("n_error"))
    everything = Window.partitionBy(F.lit(0))  # one row per cluster
    base = F.try_divide(F.sum("n_error").over(everything), F.sum("n").over(everything))
    rate = F.col("n_error") / F.col("n")
    return by.select(cluster, "n", "n_error", F.round(rate, 6).alias("error_rate"), F.round(F.try_divide(rate, base), 6).alias("lift"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two clusterings, in one row."""
    pairs = lambda n: n * (n - 1) / 2
    cell = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("ra"), F.sum("n").alias("total"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("rb"))
    both = cell.agg(F.sum(pairs(F.col("n"))).alias("rc"))
    parts = rows.unionByName(cols, allowMissingColumns=True).unionByName(both, allowMissingColumns=True)
    one = parts.agg(*[F.max(c).alias(c) for c in ("ra", "rb", "rc", "total")])
    expected = F.try_divide(F.col("ra") * F.col("rb"), pairs(F.col("total")))
    return one.select(F.round(F.try_divide(F.col("rc") - expected, (F.col("ra") + F.col("rb")) / 2 - expected), 6).alias("adjusted_rand"))


def effect_size(df: DataFrame, group: Column, value: str) -> DataFrame:
    """Cohen's d of two groups (true and false) with the pooled deviation, in one row; null where that is 0 or unknown."""
    one = df.where(group.isNotNull() & F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    a, b = F.when(F.col("g"), F.col("v")), F.when(~F.col("g"), F.col("v"))
    n = one.agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.avg(a).alias("m1"), F.avg(b).alias("m0"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v0"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return n.select("n1", "n0", F.round(F.try_divide(F.col("m1") - F.col("m0"), pooled), 6).alias("effect_size"))


def balanced(n: DataFrame) -> DataFrame:
    """Adds the balanced accuracy to rows with tp, tn, fp, fn; a side without rows counts 0."""
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return n.withColumn("balanced_accuracy", F.round((safe(tp, tp + fn) + safe(tn, tn + fp)) / 2, 6))


def by_policy(swept: DataFrame, recall: float) -> DataFrame:
    """Two rows of a sweep under column ``policy``: ``max_f1``, and ``max_precision_at_recall``.

    The second is the best precision among thresholds of at least ``recall``; if
    there is none, the best recall. Ties go to the lower threshold.
    """
    enough = F.col("recall") >= recall
    first, second = F.when(enough, F.col("precision")).otherwise(F.col("recall")), F.when(enough, F.col("recall")).otherwise(F.col("precision"))
    row = F.struct(*swept.columns)
    low = -F.col("threshold")
    one = swept.agg(F.max_by(row, F.struct(F.col("f1"), low)).alias("a"), F.max_by(row, F.struct(enough, first, second, low)).alias("b"))
    both = one.select(F.explode(F.array(F.struct(F.lit("max_f1").alias("policy"), F.col("a").alias("r")), F.struct(F.lit("max_precision_at_recall").alias("policy"), F.col("b").alias("r")))).alias("x"))
    return both.select("x.policy", "x.r.*")


def ranked_runs(measures: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """Adds ``rank`` by the measures, best first (ties by name), and ``behind``: the first measure's distance from the best. One row per run."""
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(*[F.desc(c) for c in by], F.asc(name))
    return measures.withColumn("rank", F.row_number().over(order)).withColumn("behind", F.round(F.max(by[0]).over(everything) - F.col(by[0]), 6))


def baselines(df: DataFrame, key: str, gold: str, seed: int) -> DataFrame:
    """Measures of all_keep (0), all_remove (1) and by_prior (1 with the prior's probability, by a hash of seed and key)."""
    prior = df.agg(F.avg(gold).alias("prior"))  # one row
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    d = df.join(F.broadcast(prior), F.lit(True))
    kinds = F.array(*[F.struct(F.lit(n).alias("baseline"), y.alias("yhat")) for n, y in (("all_keep", F.lit(0)), ("all_remove", F.lit(1)), ("by_prior", (u < F.col("prior")).cast("int")))])
    return confusion(d.select(gold, F.explode(kinds).alias("k")).select(gold, "k.*"), ["baseline"], gold, "yhat")


def bucket(gold: str, predicted: str) -> Column:
    """tp, fn, fp or tn."""
    g, p = F.col(gold) == 1, F.col(predicted) == 1
    return F.when(g & p, "tp").when(g, "fn").when(p, "fp").otherwise("tn")


def lift_by_split(df: DataFrame, cluster: str, error: str, split: str) -> DataFrame:
    """n, rate and lift over the split's own rate of each cluster, in columns of train and test."""
    own = lambda s: F.when(F.col(split) == s, F.col(error))
    base = df.agg(*[F.avg(own(s)).alias(f"base_{s}") for s in ("train", "test")])  # one row
    c = df.groupBy(cluster).agg(*[F.count(own(s)).alias(f"n_{s}") for s in ("train", "test")], *[F.avg(own(s)).alias(f"rate_{s}") for s in ("train", "test")])
    d = c.join(F.broadcast(base), F.lit(True))
    for s in ("train", "test"):
        d = d.withColumn(f"lift_{s}", F.when(F.col(f"base_{s}") != 0, F.col(f"rate_{s}") / F.col(f"base_{s}")))
    return d.drop("base_train", "base_test")


def flagged(sides: DataFrame, least: int = 15, high: float = 1.25, low: float = 0.70, steady: float = 0.08) -> DataFrame:
    """Adds ``flags``: high_lift_ or low_error_ with stable or unstable, small_test, or nothing."""
    lifts = F.array("lift_train", "lift_test")
    state = F.when(F.abs(F.col("rate_train") - F.col("rate_test")) <= steady, "stable").otherwise("unstable")
    both = lambda test: F.forall(lifts, lambda x: F.coalesce(test(x), F.lit(False)))
    found = F.when(F.col("n_test") < least, "small_test").when(both(lambda x: x >= high), F.concat(F.lit("high_lift_"), state)).when(both(lambda x: x <= low), F.concat(F.lit("low_error_"), state)).otherwise("")
    return sides.withColumn("flags", found)


def midpoint_accuracy(df: DataFrame, gold: str, score: str) -> DataFrame:
    """n and accuracy of predicting the group whose mean is on the score's side of the two means' middle."""
    m = df.agg(F.avg(F.when(F.col(gold) == 1, F.col(score))).alias("m1"), F.avg(F.when(F.col(gold) != 1, F.col(score))).alias("m0"))  # one row
    d = df.join(F.broadcast(m), F.lit(True))
    middle = (F.col("m1") + F.col("m0")) / 2
    yes = F.when(F.col("m1") >= F.col("m0"), F.col(score) >= middle).otherwise(F.col(score) < middle)
    return d.agg(F.count("*").alias("n"), F.round(F.avg((yes.cast("int") == F.col(gold)).cast("int")), 6).alias("accuracy"))
