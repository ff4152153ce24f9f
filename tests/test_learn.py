"""Models, reductions and texts with known results."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from quorate.functions import lexicon, parse, text, truncate, vectors
from quorate.operators import evaluate, learn, ranks, reshape


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(-2, 1, (60, 3)), rng.normal(2, 1, (60, 3))])
    data = [(i, int(i >= 60), [float(a) for a in p]) for i, p in enumerate(x)]
    return x, spark.createDataFrame(data, "i int, label int, v array<double>").withColumn("features", array_to_vector("v")).cache()


def test_scaling_reduction_and_discriminant(points):
    x, d = points
    got = np.array([r["s"] for r in learn.standardised(d, d).orderBy("i").select(vector_to_array("scaled").alias("s")).collect()])
    assert np.allclose(got, (x - x.mean(0)) / x.std(0))
    reduced, shares = learn.reduced(d, d, "features", "pc", least=1, most=3)
    got = np.array([r["p"] for r in reduced.orderBy("i").select(vector_to_array("pc").alias("p")).collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert len(shares) == 1 and shares[0] == pytest.approx(s[0] ** 2 / (s**2).sum()) and np.allclose(np.abs(got[:, 0]), np.abs(u[:, 0] * s[0]))
    ld = np.array([r["ld"] for r in learn.discriminant(d, d, "features", "label", "ld").orderBy("i").collect()])
    assert ld[60:].mean() - ld[:60].mean() > 3


def test_classifiers_and_clusters(points):
    _, d = points
    for model in (learn.logistic(d), learn.logistic(d, balanced=True), learn.boosted(d, trees=5, depth=2)):
        p = learn.scores(model, d).withColumn("y", (F.col("score") >= 0.5).cast("int"))
        assert evaluate.confusion(p, [], "label", "y").first()["accuracy"] > 0.95
    assert [n for n, _ in learn.coefficients(learn.logistic(d), ["a", "b", "c"], 2)][0] in "abc"
    with pytest.raises(ValueError):
        learn.logistic(d.where("label = 1"))
    best, k, found = learn.k_means_by_silhouette(d, "features", [2, 3])
    assert k == 2 and found[2] > found[3]
    assert evaluate.adjusted_rand(best, "label", "cluster").first()[0] > 0.9


def test_calibration(spark):
    rng = random.Random(1)
    data = [(i, p, int(rng.random() < p**2)) for i in range(600) for p in [rng.random()]]
    d = spark.createDataFrame(data, "i int, p double, y int").withColumn("extra", F.lit("kept"))
    before = evaluate.brier_ece(d, "y", "p").first()["brier"]
    for method in ("sigmoid", "isotonic"):
        c = learn.calibrated(d, d, "y", "p", method)
        assert c.columns == d.columns and evaluate.brier_ece(c, "y", "p").first()["brier"] < before
    with pytest.raises(ValueError):
        learn.calibrated(d, d, "y", "p", "none")


def test_matrix_and_one_hot(spark):
    d = spark.createDataFrame([("a", "1.5"), ("b", None), (None, "x")], "c string, n string")
    stages = learn.matrix(d.where("c IS NOT NULL"), ["n"], ["c"])
    other = spark.createDataFrame([("a", "2"), ("z", "3")], "c string, n string")
    assert [[float(x) for x in r[0].toArray()] for r in stages.transform(learn.prepared(other, ["n"], ["c"])).select("features").collect()] == [[2.0, 1.0, 0.0], [3.0, 0.0, 0.0]]
    assert rows(other.select(*learn.one_hot("c", ["a", "b"]))) == [(0, 0), (1, 0)]


def test_ranks_totals_and_quantiles(spark):
    rng = random.Random(2)
    data = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([1.0, 2.0, 5.0, None])) for i in range(500)]
    rng.shuffle(data)
    d = spark.createDataFrame(data, "g string, i int, v double")
    seen: dict = {}
    want = {i: seen.setdefault(g, []).append(i) or len(seen[g]) for g, i, _ in sorted(data, key=lambda r: r[1])}
    got = ranks.ranked(d, ["g"], ["i"], "r", "n").collect()
    assert {r["i"]: r["r"] for r in got} == want and all(r["n"] == len(seen[r["g"]]) for r in got)
    total, upto = 0, {}
    for _, i, v in sorted(data, key=lambda r: r[1]):
        total += v or 0
        upto[i] = total
    assert {r["i"]: r["upto_v"] or 0 for r in ranks.running_total(d, ["i"], ["v"]).collect()} == upto
    q = {r["g"]: (r["m"], r["u"]) for r in ranks.quantiles(d, ["g"], "v", {"m": 0.5, "u": 0.75}).collect()}
    for g in seen:
        values = [v for h, _, v in data if h == g and v is not None]
        assert q[g] == pytest.approx((np.median(values), np.quantile(values, 0.75)))
    assert ranks.ranked(d.limit(0), ["g"], ["i"]).count() == 0


def test_truncation():
    assert truncate.is_complete("We agree.") and truncate.is_complete('He said "yes."') and not truncate.is_complete("We agree with the.") and not truncate.is_complete("so...") and not truncate.is_complete("")
    assert truncate.sentence("One two. Three four. Five six seven", 20) == "One two. Three four."
    assert truncate.sentence("Wait... what is this then. And more and more words", 25) == "Wait... what is this then."
    assert truncate.sentence("no stop here at all anywhere in it", 12) == "no stop"
    assert truncate.sentence("first line.\nsecond", 60) == "first line." and truncate.sentence("short", 60) == "short" and truncate.sentence("  ", 9) == ""


def test_truncation_cascade(spark):
    cases = [("short", "short"), ("aaaa bbbb cccc dddd", "aaaa bbbb"), ("aaaaaaaa. bbbbbbbb", "aaaaaaaa."), ("aaaa; bbbbbbbbbbbbbb", "aaaa;"), ("aaaaaaaaaaaaaaaaaa", "aaaaaaaaaa"), ("aaaaaaaa\nbbbbbbb", "aaaaaaaa"), ("aaaaaa... bbbbbbbb", "aaaaaa...")]
    d = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in d.select(truncate.cascade(F.col("t"), F.lit(10))).collect()] == [w for _, w in cases]


def test_parsing(spark):
    d = spark.createDataFrame([(' "Keep." I think', 0), ("REMOVE", 1), ("", 1), (None, 0), ("maybe keep", 1)], "t string, y int")
    p = d.withColumn("p", parse.decision("t"))
    assert [tuple(r) for r in p.select("p", parse.effective_label("p", "y")).collect()] == [("keep", 0), ("remove", 1), ("__invalid__", 0), ("__invalid__", 1), ("__invalid__", 0)]
    with pytest.raises(Exception, match="unexpected decision"):
        d.select(parse.label("t")).collect()
    one = spark.createDataFrame([("reddit_1", "a, b"), ("twitter_2", "No")], "k string, l string")
    assert rows(one.select(parse.platform("k"), parse.all_in("l", ["a", "b"]))) == [("reddit", True), ("twitter", False)]
    with pytest.raises(Exception, match="unknown platform"):
        one.select(parse.platform(F.lit("mars_1"))).collect()
    tiers = spark.createDataFrame([(True, True), (True, False), (False, True)], "a boolean, b boolean")
    assert [r[0] for r in tiers.select(parse.tier([F.col("a"), F.col("b")])).collect()] == [1, 2, 3]
    t = spark.createDataFrame([(1736295728,), (1752000000,)], "s long")
    assert [r[0] for r in t.select(parse.local_time("s")).collect()] == ["2025-01-07 18:22:08-06:00", "2025-07-08 13:40:00-05:00"]
    n = spark.createDataFrame([("run 2025_01_02-03:04:05",), ("none",)], "n string").select(parse.run_time("n").alias("at"))
    assert [r[0] for r in n.select(parse.run_name("at")).collect()] == ["2025_01_02-03:04:05", None]


def test_lexicon_and_texts(spark):
    d = spark.createDataFrame([("We praise them",), (None,)], "t string")
    assert [tuple(r) for r in d.select(*[lexicon.classify(n, "t") for n in ("is_positive", "is_intergroup", "is_prime")]).collect()] == [(True, True, False), (False, False, False)]
    with pytest.raises(KeyError):
        lexicon.classify("none", "t")
    assert [r["x"] for r in lexicon.classify_with(d, "t", "x", lambda ts: [bool(t) for t in ts]).collect()] == [True, False]
    t = spark.createDataFrame([("a  b\n c &amp; d", "the big cat sat")], "t string, u string")
    assert tuple(t.select(text.collapsed("t"), text.collapsed("t", 4), text.plain_entities("t"), text.grams(text.terms("u", ["the"]), 2)).first()) == ("a b c &amp; d", "a b…", "a b c & d", ["big cat", "cat sat"])
    assert t.select(text.grams(text.terms(F.lit("one"), []), 2)).first()[0] == []


def test_roles_and_versions(spark):
    d = spark.createDataFrame([("p", "a \r\n", "b"), ("q", None, " "), (None, "x", "y")], "id string, o string, m string")
    i = reshape.instances(d, "id", {"original": "o", "mirror": "m"})
    assert rows(i.select("id", "role", "text")) == [("p", "mirror", "b"), ("p", "original", "a \r\n")]
    side = spark.createDataFrame([("a", 1)], "k string, v int")
    j = reshape.join_roles(spark.createDataFrame([("a", "b")], "x string, y string"), {"l": "x", "r": "y"}, side, "k", "v")
    assert tuple(j.select("l_v", "r_v").first()) == (1, None)
    with pytest.raises(ValueError):
        reshape.require_covered(j, "r_v")
    a, b = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "x"), (2, None), (4, "w")], "k int, v string")
    assert rows(reshape.reconcile(a, b, "k", "v")) == [(1, "same"), (2, "same"), (3, "missing"), (4, "unexpected")]
    v = spark.createDataFrame([([3.0, 4.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert tuple(v.select(vectors.unit("a"), vectors.difference("a", "b"), vectors.equivalent("a", "b", 3.0)).first()) == ([0.6, 0.8], [2.0, 3.0], True)
    with pytest.raises(Exception, match="different lengths"):
        v.select(reshape.zipped(F.col("a"), F.array(F.lit(1.0)))).collect()


def test_values_of_several_tiers(spark):
    d = spark.createDataFrame([("a",), ("b",), ("b",), ("c",), (None,)], "k string")
    near, far = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 9), ("b", 2)], "k string, v int")
    got = reshape.resolved(d, "k", "v", {"near": near, "far": far})
    assert rows(got.select("k", "v", "tier")) == [("a", 1, "near"), ("b", 2, "far"), ("b", 2, "far"), ("c", None, "missing"), (None, None, "missing")]
    made = reshape.resolved(d, "k", "v", {"near": near}, lambda left: left.withColumn("v", F.length("k")))
    assert rows(made.where("tier = 'made'").select("k", "v")) == [("b", 1), ("b", 1), ("c", 1)]
