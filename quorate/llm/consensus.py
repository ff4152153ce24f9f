"""Consensus labels from several annotators by confidence-aware truth discovery.

An annotator's weight is the lower chi-squared quantile at the number of their
labels over the sum of their squared distances to the current truths, that is,
the inverse of an upper confidence bound on their error variance: contributors
with few labels are not trusted for a lucky run. Truths are weighted means of
the labels; the two steps alternate until the weights settle.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.staging import discard, stage

#: Votes of one annotator or item that a task joins at most; hotter ones are spread over more join keys.
HOT = 100_000

#: Error per label that is assumed beside the observed one. Without it an
#: annotator who meets no one else would be without error, and outweigh all.
BASE_ERROR = 0.02


def chi_squared(p: float, n: Column) -> Column:
    """The p quantile of the chi-squared distribution, by Wilson and Hilferty's cube."""
    z = NormalDist().inv_cdf(p)
    c = F.lit(2.0) / (9 * n)
    return n * F.pow(F.greatest(1 - c + z * F.sqrt(c), F.lit(1e-3)), F.lit(3.0))


def _copies(n: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / HOT), F.lit(1)).cast("int")


def _salted_join(votes: DataFrame, small: DataFrame, on: str, salt: str) -> DataFrame:
    """Join with one row per key: column ``n`` (its votes) says over how many keys a hot one was spread.

    Both sides grow with the data, so neither is broadcast.
    """
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), _copies("n") - 1))).drop("n")
    return votes.join(copies.hint("merge"), [on, salt])


def votes_of(df: DataFrame, item: str, annotator: str, label: Column, order: list[str]) -> DataFrame:
    """One vote (item, annotator, y) for each pair; the first by ``order`` counts.

    ``label`` is 1, 0 or null (no vote). Rows without item or annotator drop out.
    """
    first = F.min_by("y", F.struct(*order))
    votes = df.withColumn("y", label.cast("double")).where(F.col("y").isNotNull() & F.col(item).isNotNull() & F.col(annotator).isNotNull())
    votes = votes.groupBy(F.col(item).alias("item"), F.col(annotator).alias("annotator")).agg(first.alias("y"))
    for key, other, salt in (("item", "annotator", "__si"), ("annotator", "item", "__sa")):
        # At most one in HOT votes is a row of these.
        hot = votes.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > HOT).withColumn("copies", _copies("n")).drop("n")
        votes = votes.join(hot, key, "left").withColumn(salt, F.when(F.col("copies").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.col("copies"))).cast("int")).drop("copies")
    return votes


def _truths(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("item").agg(F.count("*").alias("n"), F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("y")).alias("ones_mass"))


def discover(votes: DataFrame, alpha: float = 0.05, settled: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Items (item, truth, n, share, agreement, label) and annotators (annotator, n, weight, hit, false, informedness).

    ``votes`` comes from :func:`votes_of` and should be staged. ``truth`` is the
    weighted mean, ``label`` whether it is above one half (a tie counts as 1);
    ``agreement`` is the share of votes equal to the label. ``hit`` and ``false``
    are the shares of an annotator's 1-labels on items whose truth, without
    their own vote, is 1 or 0 (as soft counts); ``informedness`` is hit - false,
    null where either is unknown. No votes give empty results.
    """
    start = votes.groupBy("annotator").agg(F.count("*").cast("double").alias("n")).withColumn("w", F.lit(1.0))
    weights = stage(start, "p1-weights")
    before = math.inf
    while True:
        weighted = _salted_join(votes, weights.select("annotator", "w", "n"), "annotator", "__sa")
        truth = _truths(weighted).select("item", "n", (F.col("ones_mass") / F.col("mass")).alias("t"))
        error = _salted_join(votes, truth, "item", "__si").groupBy("annotator").agg(F.count("*").cast("double").alias("n"), F.sum(F.pow(F.col("y") - F.col("t"), F.lit(2.0))).alias("e"))
        raw = error.withColumn("w", chi_squared(alpha / 2, F.col("n")) / (F.col("e") + BASE_ERROR * F.col("n")))
        after = stage(raw.select("annotator", "n", "w"), "p1-weights")
        moved = after.join(weights.select("annotator", F.col("w").alias("w0")).hint("merge"), "annotator").agg((F.sum(F.abs(F.col("w") - F.col("w0"))) / F.sum("w0")).alias("d")).first()["d"]
        discard(weights)
        weights = after
        # Alternating minimisation: the steps shrink until the weights settle, or no longer shrink.
        if moved is None or moved < settled or moved >= before:
            break
        before = moved
    weighted = stage(_salted_join(votes, weights.select("annotator", "w", "n"), "annotator", "__sa"), "p1-weighted")
    truth = _truths(weighted)
    seen = _salted_join(weighted, truth, "item", "__si")
    rest = F.col("mass") - F.col("w")
    seen = seen.withColumn("t", F.when(rest > 1e-9 * F.col("mass"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ones_mass") - F.col("w") * F.col("y")) / rest))))
    hit = F.try_divide(F.sum(F.col("y") * F.col("t")), F.sum("t"))
    false = F.try_divide(F.sum(F.col("y") * (1 - F.col("t"))), F.sum(1 - F.col("t")))
    annotators = seen.groupBy("annotator").agg(F.count("*").alias("n"), F.first("w").alias("weight"), hit.alias("hit"), false.alias("false"))
    annotators = annotators.withColumn("informedness", F.col("hit") - F.col("false"))
    label = (F.col("ones_mass") >= 0.5 * F.col("mass")).cast("int")
    items = weighted.groupBy("item").agg(F.count("*").alias("n"), F.sum("y").alias("ones"), F.sum("w").alias("mass"), F.sum(F.col("w") * F.col("y")).alias("ones_mass"))
    items = items.select("item", (F.col("ones_mass") / F.col("mass")).alias("truth"), "n", (F.col("ones") / F.col("n")).alias("share"), F.when(label == 1, F.col("ones")).otherwise(F.col("n") - F.col("ones")).alias("__same"), label.alias("label"))
    items = items.withColumn("agreement", F.col("__same") / F.col("n")).drop("__same")
    return items, annotators


def reliable_majority(votes: DataFrame, annotators: DataFrame, least: float, minimum: int, share: float) -> DataFrame:
    """Items whose votes, without annotators below ``least`` informedness, are by at least ``share`` ones.

    An annotator whose informedness is unknown stays.
    """
    good = annotators.where(F.coalesce(F.col("informedness") >= least, F.lit(True))).select("annotator", "n")
    kept = _salted_join(votes, good, "annotator", "__sa")
    by = kept.groupBy("item").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    return by.where((F.col("n") >= minimum) & (F.col("ones") >= share * F.col("n") - 1e-9))
