"""Similarity clusters by a Gaussian mixture of as many components as the criterion asks for.

A record is its weighted words, projected on ``DIMENSIONS`` signs of their hashes
and standardised over all records. Components have spherical covariances that are
regularised towards a floor. The mixture is found in four steps:

1. records are laid out by their rarest shared word, and each layout of records is
   divided in two by expectation-maximisation for as long as the Bayesian
   information criterion falls;
2. expectation-maximisation over all components: a record weighs its own
   component against all whose common words may be near its own, until almost
   none moves;
3. components whose union has the better criterion unite, until none do, and
   records are weighed once more;
4. records too far from the mean of their component belong to the background.

Step 1 sees at most ``LAYOUT`` records at a time: larger layouts are divided by a
second word and then at random, and step 3 unites again what belongs together.
Everything else is joins and aggregations with partial sums, so that components
may be of any size. Records with the same words count as one form with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quorate.staging import discard, stage

#: Reduced dimensions, a multiple of 64.
DIMENSIONS = 192
#: Weight of the words of the second text beside those of the first.
BESIDE = 0.5
#: Least variance of a component, and the records of that variance that every component is given beforehand.
FLOOR, PRIOR = 0.35, 8.0
#: Variance within a component that a union may have, and the records that tell of a union at most.
WITHIN, TOLD = 0.5, 2.0
#: Farthest squared distance per dimension of a member from the mean of the others, beyond which the background is likelier.
FARTHEST = 0.6
#: Least records of a cluster, and of a word that can hold one together.
LEAST = 3
#: Most records that one task divides at a time.
LAYOUT = 5000
#: A component's word is one that this share of its records has.
COMMON = 0.5
#: Least cosine with a component's common words of a record, or of another one's common words, for the two to be compared:
#: a mean m with less is farther than the background, as (1 + |m|^2 - d) / 2 / |m| is at least this for d up to 0.72.
NEAR = 0.55
#: Salts of a hot word, and the share of records at whose moving expectation-maximisation ends.
SALTS, SETTLED = 16, 1e-2


def _words(c: str) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"['’]s\b", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)))


def _forms(df: DataFrame, key: str, text: str, beside: str | None) -> tuple[DataFrame, DataFrame]:
    """Members (key, form) and forms (form, weight, first, second) of equal word sets."""
    second = _words(beside) if beside else F.array().cast("array<string>")
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), _words(text).alias("first"), second.alias("second"))
    rows = rows.where(F.size("first") + F.size("second") > 0).withColumn("form", F.sha2(F.concat(F.concat_ws(" ", "first"), F.lit("\n"), F.concat_ws(" ", "second")), 256))
    # A number in place of the hash: the forms are written once, so it stays.
    counted = rows.groupBy("form").agg(F.first("first").alias("first"), F.first("second").alias("second"), F.count_distinct("key").alias("weight"))
    forms = stage(counted.withColumn("id", F.monotonically_increasing_id()), "cluster-forms")
    members = rows.select("key", "form").distinct().join(forms.select("form", "id"), "form").select("key", F.col("id").alias("form"))
    return stage(members, "cluster-members"), forms.select(F.col("id").alias("form"), "weight", "first", "second")


def _terms(forms: DataFrame, n: float) -> DataFrame:
    """form, weight, term, count (records with the term), u (weight in the unit vector), ahead (norm from here on, rarest first) and lead (a word of the first text)."""
    t = forms.select("form", "weight", "first", "second", F.explode(F.array_union("first", "second")).alias("term"))
    t = t.withColumn("lead", F.array_contains("first", F.col("term")))
    t = t.withColumn("tf", F.col("lead").cast("double") + BESIDE * F.array_contains("second", F.col("term")).cast("double")).drop("first", "second")
    counts = t.groupBy("term").agg(F.sum("weight").alias("count"))
    # The counts are copied for each salt, so that a word that most records have is spread.
    salted = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    t = t.withColumn("salt", F.pmod("form", F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"]).drop("salt")
    # A word that fewer than LEAST records have tells as much as one that LEAST have.
    t = t.withColumn("x", F.col("tf") * (F.log(F.lit(n) / F.greatest("count", F.lit(LEAST))).cast("double") + 0.01))
    return _ahead(t, "form", "x").select("form", "weight", "term", "count", "lead", (F.col("x") / F.col("norm")).alias("u"), "ahead")


def _ahead(df: DataFrame, key: str, x: str) -> DataFrame:
    """Adds the norm of a key's weights, and ``ahead``: what of it (from 1 down) is left from this word on, rarest first.

    Where a word is the first one that two keys share, their cosine is at most the product of what both have ahead.
    """
    own = Window.partitionBy(key)  # as many rows as the texts have words
    square = F.col(x) * F.col(x)
    d = df.withColumns({"whole": F.sum(square).over(own), "upto": F.sum(square).over(own.orderBy("count", "term").rowsBetween(Window.unboundedPreceding, 0))})
    return d.withColumn("ahead", F.sqrt(F.greatest(F.lit(0.0), 1 - (F.col("upto") - square) / F.col("whole")))).withColumn("norm", F.sqrt("whole")).drop("whole", "upto")


def _meeting(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (a, b) of two tables of (term, key, ahead) whose first shared word lets them have a cosine of NEAR."""
    tops = [s.groupBy("term").agg(F.max("ahead").alias("top")) for s in (a, b)]
    # Lists are cut to what can meet the best of the other side, so that those of hot words are short.
    a, b = (s.join(top, "term").where(F.col("ahead") * F.col("top") >= NEAR).drop("top") for s, top in ((a, tops[1]), (b, tops[0])))
    met = a.select("term", F.col("key").alias("a"), F.col("ahead").alias("ra")).join(b.select("term", F.col("key").alias("b"), F.col("ahead").alias("rb")), "term")
    return met.where(F.col("ra") * F.col("rb") >= NEAR).select("a", "b").distinct()


def _lists(words: DataFrame, key: str, x: str) -> DataFrame:
    """key, ts (hashes of its words) and us (their weights)."""
    d = words.groupBy(key).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col(x).cast("float").alias("u"))).alias("w"))
    return d.select(key, F.transform("w", lambda w: w["t"]).alias("ts"), F.transform("w", lambda w: w["u"]).alias("us"))


def _close(pairs: DataFrame) -> DataFrame:
    """The (form, comp) of rows (form, comp, ts, us, tc, uc) whose words have a dot product of NEAR."""

    def dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = [np.repeat(np.arange(b.num_rows, dtype=np.int64), b.column(i).value_lengths().to_numpy(zero_copy_only=False)) for i in (2, 4)]
            keys = [b.column(i).flatten().to_numpy(zero_copy_only=False) ^ r * np.int64(0x9E3779B97F4A7C1) for i, r in zip((2, 4), row, strict=True)]
            _, i, j = np.intersect1d(*keys, return_indices=True)
            products = b.column(3).flatten().to_numpy(zero_copy_only=False)[i] * b.column(5).flatten().to_numpy(zero_copy_only=False)[j]
            near = np.bincount(row[0][i], products, b.num_rows) >= NEAR
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(near)) for c in (0, 1)], names=["form", "comp"])

    return pairs.mapInArrow(dots, "form long, comp long")


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _vectors(terms: DataFrame) -> DataFrame:
    """form, weight, rare (the one or two rarest shared words, null without any) and x, the projection, before it is standardised."""
    halves = DIMENSIONS // 64
    bits = F.array(*[F.xxhash64(F.lit(k), "term") for k in range(halves)])
    shared = F.when(F.col("count") >= LEAST, F.struct("count", "term"))
    rows = terms.withColumn("bits", bits).groupBy("form", "weight").agg(F.collect_list(F.struct("bits", "u")).alias("t"), F.collect_list(F.when(F.col("lead"), shared)).alias("leads"), F.min(shared).alias("other"))
    rarest = F.coalesce(F.transform(F.slice(F.array_sort("leads"), 1, 2), lambda s: s["term"]), F.array().cast("array<string>"))
    rows = rows.select("form", "weight", F.when(F.size(rarest) > 0, rarest).when(F.col("other").isNotNull(), F.array("other.term")).alias("rare"), F.flatten(F.transform("t", lambda s: s["bits"])).alias("bits"), F.transform("t", lambda s: s["u"]).alias("u"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = b.column(4).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(b.column(4).offsets.to_numpy())
            hashed = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8)
            signs = np.unpackbits(hashed).reshape(len(u), DIMENSIONS).astype(np.float64) * 2 - 1
            x = np.zeros((b.num_rows, DIMENSIONS))
            np.add.at(x, np.repeat(np.arange(b.num_rows), sizes), signs * u[:, None])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["form", "weight", "rare", "x"])

    return rows.mapInArrow(project, "form long, weight long, rare array<string>, x array<float>")


def _scales(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the dimensions over all records: partial sums per task, added up per dimension."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s, q = 0.0, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
        for b in batches:
            x, weight = _matrix(b.column(1)), b.column(0).to_numpy().astype(float)
            w, s, q = w + weight.sum(), s + weight @ x, q + weight @ (x * x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS)), pa.array(np.full(DIMENSIONS, w)), pa.array(s), pa.array(q)], names=["d", "w", "s", "q"])

    parts = vectors.select("weight", "x").mapInArrow(sums, "d long, w double, s double, q double")
    rows = parts.groupBy("d").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("d").collect()  # DIMENSIONS rows
    w, s, q = (np.array([r[c] for r in rows]) for c in ("w", "s", "q"))
    mean = s / np.maximum(w, 1e-9)
    return mean, np.sqrt(np.maximum(q / np.maximum(w, 1e-9) - mean * mean, 1e-12))


def _standardised(vectors: DataFrame, mean: np.ndarray, deviation: np.ndarray) -> DataFrame:
    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = ((_matrix(b.column(3)) - mean) / deviation).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(x), pa.list_(pa.float32()))], names=["form", "weight", "rare", "x"])

    return vectors.mapInArrow(scale, "form long, weight long, rare array<string>, x array<float>")


def _log_densities(x: np.ndarray, means: np.ndarray, variances: np.ndarray, shares: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ means.T + (means * means).sum(1)[None]
    return np.log(shares)[None] - 0.5 * d / variances[None] - 0.5 * x.shape[1] * np.log(2 * np.pi * variances)[None]


def _variance(x: np.ndarray, mean: np.ndarray, r: np.ndarray) -> float:
    return max(FLOOR, float(r @ ((x - mean) ** 2).sum(1)) / (x.shape[1] * max(float(r.sum()), 1e-9)))


def _one(x: np.ndarray, w: np.ndarray) -> float:
    """Log likelihood of one component."""
    mean = w @ x / w.sum()
    return float(w @ _log_densities(x, mean[None], np.array([_variance(x, mean, w)]), np.ones(1))[:, 0])


def _two(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Log likelihood and labels of two components, started along the longest axis; None if one is left empty."""
    centred = x - w @ x / w.sum()
    axis = centred[np.argmax((centred * centred).sum(1))]
    for _ in range(4):
        axis = centred.T @ (w * (centred @ axis))
        axis /= max(float(np.linalg.norm(axis)), 1e-12)
    first = (centred @ axis > 0).astype(float)
    r, before = np.stack([first, 1 - first], 1), -np.inf
    while True:
        held = (r * w[:, None]).sum(0)
        if held.min() < 0.5:
            return None
        means = (r * w[:, None]).T @ x / held[:, None]
        variances = np.array([_variance(x, means[k], r[:, k] * w) for k in (0, 1)])
        d = _log_densities(x, means, variances, held / held.sum())
        top = d.max(1, keepdims=True)
        e = np.exp(d - top)
        whole = e.sum(1, keepdims=True)
        r, now = e / whole, float(w @ (top + np.log(whole))[:, 0])
        if now - before < 1e-4 * abs(now):  # the likelihood never falls by more than rounding, so this ends
            return now, r.argmax(1)
        before = now


def divide(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels of the components that the information criterion asks for, divided in two again and again."""
    labels, todo, k = np.zeros(len(x), np.int64), [np.arange(len(x))], 0
    while todo:
        i = todo.pop()
        if len(i) > 1:
            two = _two(x[i], w[i])
            if two is not None and 0 < two[1].sum() < len(i) and 2 * (two[0] - _one(x[i], w[i])) > (x.shape[1] + 2) * np.log(w[i].sum()):
                todo += [i[two[1] == 0], i[two[1] == 1]]
                continue
        labels[i] = k
        k += 1
    return labels


def _layouts(vectors: DataFrame) -> DataFrame:
    """Adds ``layout``: the rarest word; where more than LAYOUT forms share it the two rarest, and where that is not enough a part by hash."""
    one = F.element_at("rare", 1)
    two = F.concat_ws("\t", "rare")
    n1 = vectors.groupBy(one.alias("one")).agg(F.count("*").alias("n1")).where(F.col("n1") > LAYOUT)
    n2 = vectors.groupBy(one.alias("one"), two.alias("two")).agg(F.count("*").alias("n2")).where(F.col("n2") > LAYOUT)
    # At most one in LAYOUT forms is a row of these.
    d = vectors.withColumns({"one": one, "two": two}).join(n1, "one", "left").join(n2, ["one", "two"], "left")
    part = F.pmod(F.xxhash64("form"), F.ceil(F.col("n2") / LAYOUT)).cast("string")
    layout = F.when(F.col("n1").isNull(), F.col("one")).when(F.col("n2").isNull(), F.col("two")).otherwise(F.concat_ws("\t", "two", part))
    return d.select("form", "weight", "x", layout.alias("layout"))


def _components(laid: DataFrame) -> DataFrame:
    """form, weight, x and comp, the component of step 1: the hash of layout and number."""

    def components(table: pa.Table) -> pa.Table:
        one = table.combine_chunks()
        x, w = _matrix(one["x"].combine_chunks()), one["weight"].to_numpy().astype(float)
        labels = divide(x, w) if len(x) > 1 else np.zeros(1, np.int64)
        return one.append_column("k", pa.array(labels))

    done = laid.groupBy("layout").applyInArrow(components, "form long, weight long, x array<float>, layout string, k long")
    return done.select("form", "weight", "x", F.xxhash64("layout", "k").alias("comp"))


def _stats(placed: DataFrame) -> DataFrame:
    """comp, n, mean and q (mean squared norm per dimension), by partial sums in the JVM."""
    v = placed.select("comp", F.col("weight").cast("double").alias("w"), array_to_vector("x").alias("v"))
    s = v.groupBy("comp").agg(Summarizer.metrics("mean", "normL2").summary(F.col("v"), F.col("w")).alias("s"), F.sum("w").alias("n"), F.sum(F.col("w") * F.aggregate(vector_to_array("v"), F.lit(0.0), lambda a, y: a + y * y)).alias("q"))
    return s.select("comp", "n", vector_to_array("s.mean", "float32").alias("mean"), (F.col("q") / F.col("n") / DIMENSIONS).alias("q"))


def _word_sums(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """comp, term, count, c (records of the component with it) and s (sum of its weights)."""
    return placed.select("form", "comp").join(terms.where(F.col("count") >= LEAST), "form").groupBy("comp", "term", "count").agg(F.sum("weight").alias("c"), F.sum(F.col("weight") * F.col("u")).alias("s"))


def _common(sums: DataFrame, stats: DataFrame) -> DataFrame:
    """term, key (the component), ahead and m (weight in the unit vector) of the common words of each component of two records or more."""
    common = sums.join(stats.where("n >= 2").select("comp", "n"), "comp").where(F.col("c") >= COMMON * F.col("n"))
    return _ahead(common.withColumn("m", F.col("s") / F.col("n")), "comp", "m").select("term", F.col("comp").alias("key"), "ahead", (F.col("m") / F.col("norm")).alias("m"))


def _variances() -> Column:
    """Regularised variance of a component of n, mean and q."""
    spread = F.greatest(F.lit(0.0), F.col("q") - F.aggregate(F.transform("mean", lambda y: y.cast("double") * y), F.lit(0.0), lambda a, y: a + y) / DIMENSIONS)
    return F.greatest(F.lit(FLOOR), (F.col("n") * spread + PRIOR * FLOOR) / (F.col("n") + PRIOR))


def _weighed(placed: DataFrame, terms: DataFrame, lists: DataFrame) -> DataFrame:
    """form, weight, x, comp, d and moved, in place of ``placed``: every record with the component of greatest density; d is the squared distance per dimension from the mean of the others."""
    stats = stage(_stats(placed), "cluster-stats")
    common = stage(_common(_word_sums(placed, terms), stats), "cluster-common")
    met = _meeting(terms.where(F.col("count") >= LEAST).select("term", F.col("form").alias("key"), "ahead"), common.select("term", "key", "ahead")).toDF("form", "comp")
    # Words are lighter than projections: only pairs that pass by them get theirs.
    of_comps = _lists(common, "key", "m").toDF("comp", "tc", "uc")
    met = _close(met.join(lists, "form").join(of_comps, "comp").select("form", "comp", "ts", "us", "tc", "uc"))
    own = placed.select("form", "comp")
    pairs = met.unionByName(own).distinct().join(placed.select("form", "weight", "x", F.col("comp").alias("was")), "form")
    pairs = pairs.join(stats.select("comp", "n", "mean", _variances().alias("v")), "comp").join(stats.select(F.col("comp").alias("was"), F.col("n").alias("n0")), "was")
    # Whoever is alone moves to a larger component only, so that two do not change places.
    pairs = pairs.where((F.col("n0") > F.col("weight")) | (F.struct("n", "comp") >= F.struct("n0", "was"))).select("form", "weight", "was", "comp", "n", "v", "x", "mean")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, v = b.column(4).to_numpy(), b.column(5).to_numpy()
            d = ((_matrix(b.column(6)) - _matrix(b.column(7))) ** 2).mean(1) if b.num_rows else np.zeros(0)
            score = np.log(n) - 0.5 * DIMENSIONS * (d / v + np.log(v))
            # The mean of the others is farther away by n over what is left of n without the record.
            own = b.column(2).to_numpy() == b.column(3).to_numpy()
            others = n - np.where(own, b.column(1).to_numpy(), 0)
            d *= (n / np.maximum(others, 1)) ** 2
            # A form that is alone fits its own mean anyhow: what counts is how well the background has it.
            alone = own & (others < 0.5)
            x = _matrix(b.column(6))[alone]
            score[alone] = np.log(n[alone]) - 0.5 * DIMENSIONS * (x * x).mean(1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(score), pa.array(d)], names=["form", "weight", "was", "comp", "score", "d"])

    scored = pairs.mapInArrow(weigh, "form long, weight long, was long, comp long, score double, d double")
    best = scored.groupBy("form").agg(F.max_by(F.struct("comp", "d"), F.struct("score", "comp")).alias("b"), F.first("was").alias("was"))
    done = stage(placed.select("form", "weight", "x").join(best, "form").select("form", "weight", "x", "b.comp", "b.d", (F.col("b.comp") != F.col("was")).alias("moved")), "cluster-weighed")
    for used in (stats, common, placed):
        discard(used)
    return done


def _settle(placed: DataFrame, terms: DataFrame, lists: DataFrame, n: float) -> DataFrame:
    """Expectation-maximisation until at most SETTLED of the records move, or no fewer than before."""
    before = np.inf
    while True:
        placed = _weighed(placed, terms, lists)
        now = placed.where("moved").agg(F.sum("weight")).first()[0] or 0
        if now <= SETTLED * n or now >= before:
            return placed
        before = now


def _unions(stats: DataFrame, common: DataFrame) -> DataFrame:
    """comp and to: the larger component, if any, with which the union has the best criterion.

    ``h`` records tell the two means apart; beyond TOLD they tell nothing new
    (records of one wording are no independent witnesses).
    """
    common = common.select("term", "key", "ahead")
    near = _meeting(common, common).where("a < b")
    s = stats.where("n >= 2").select("comp", "n", "mean")
    met = near.join(s.toDF("a", "na", "ma"), "a").join(s.toDF("b", "nb", "mb"), "b")
    gap = F.aggregate(F.zip_with("ma", "mb", lambda p, q: (p - q).cast("double") * (p - q)), F.lit(0.0), lambda a, y: a + y)
    h = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb"))
    criterion = TOLD * h / (TOLD + h) * gap / WITHIN - (DIMENSIONS + 2) * F.log1p(F.least(F.col("na") + F.col("nb"), F.lit(2 * TOLD)))
    good = met.withColumn("criterion", criterion).where("criterion < 0")
    larger = F.when(F.struct("na", "a") > F.struct("nb", "b"), F.col("a")).otherwise(F.col("b"))
    good = good.select(larger.alias("to"), F.when(larger == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("comp"), "criterion")
    return good.groupBy("comp").agg(F.min_by("to", F.struct("criterion", "to")).alias("to"))


def _united(placed: DataFrame, terms: DataFrame) -> DataFrame:
    """The records with united components. Means and words of a union come from those of its parts, so the records are read once."""
    stats, sums = stage(_stats(placed), "cluster-stats"), stage(_word_sums(placed, terms), "cluster-words")
    names = stage(stats.select("comp", F.col("comp").alias("now")), "cluster-names")
    while True:
        links = stage(_unions(stats, _common(sums, stats)), "cluster-links")
        if not links.limit(1).count():
            break
        # Links lead to larger components only, so they form trees; pointers are doubled until they reach the roots.
        while True:
            further = links.join(links.select(F.col("comp").alias("to"), F.col("to").alias("next")), "to", "left")
            links = stage(further.select("comp", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("on")), "cluster-links")
            on = links.where("on").limit(1).count()
            links = links.drop("on")
            if not on:
                break
        to = links.withColumnRenamed("comp", "now")
        names = stage(names.join(to, "now", "left").select("comp", F.coalesce("to", "now").alias("now")), "cluster-names")
        renamed = stats.join(links, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).select("comp", "n", array_to_vector("mean").alias("v"), "q")
        merged = renamed.groupBy("comp").agg(Summarizer.mean(F.col("v"), F.col("n")).alias("m"), F.sum("n").alias("m_n"), (F.sum(F.col("n") * F.col("q")) / F.sum("n")).alias("q"))
        stats = stage(merged.select("comp", F.col("m_n").alias("n"), vector_to_array("m", "float32").alias("mean"), "q"), "cluster-stats")
        sums = stage(sums.join(links, "comp", "left").withColumn("comp", F.coalesce("to", "comp")).groupBy("comp", "term", "count").agg(F.sum("c").alias("c"), F.sum("s").alias("s")), "cluster-words")
    return placed.select("form", "weight", "x", "comp").join(names, "comp").select("form", "weight", "x", F.col("now").alias("comp"))


def cluster(df: DataFrame, key: str, text: str, beside: str | None = None) -> DataFrame:
    """feature_id, cluster_key, size and density of each record in a cluster of LEAST or more.

    ``beside`` names a second text whose words count BESIDE as much. Keys are
    compared as strings; records without key, or without a word that LEAST
    records have, are in no cluster; a null text has no words. ``cluster_key`` is
    the smallest key of the cluster, ``density`` falls with the distance to its
    mean. An empty table gives none.
    """
    texts = [c for c in (text, beside) if c]
    members, forms = _forms(df.select(key, *texts), key, text, beside)
    n = float(max(1, forms.agg(F.sum("weight")).first()[0] or 0))
    terms = stage(_terms(forms, n), "cluster-terms")
    raw = stage(_vectors(terms), "cluster-raw")
    if not raw.limit(1).count():
        return members.select(F.col("key").alias("feature_id"), F.col("key").alias("cluster_key"), F.lit(0).cast("long").alias("size"), F.lit(0.0).alias("density")).limit(0)
    # Records without a shared word count for the scales only.
    vectors = stage(_standardised(raw.where("rare IS NOT NULL"), *_scales(raw)), "cluster-vectors")
    placed = stage(_components(_layouts(vectors)), "cluster-placed")
    lists = stage(_lists(terms.where(F.col("count") >= LEAST), "form", "u"), "cluster-lists")
    placed = _settle(placed, terms, lists, n)
    placed = _settle(_united(placed, terms), terms, lists, n)
    found = members.join(placed.where(F.col("d") <= FARTHEST).select("form", "comp", "d"), "form")
    named = found.groupBy("comp").agg(F.min("key").alias("cluster_key"), F.count("*").alias("size")).where(F.col("size") >= LEAST)
    return found.join(named, "comp").select(F.col("key").alias("feature_id"), "cluster_key", "size", (-F.col("d")).alias("density"))


def typical(clustered: DataFrame, most: int = 3) -> DataFrame:
    """cluster_key, size and the ``most`` members of highest density, in order."""
    order = Window.partitionBy("cluster_key").orderBy(F.desc("density"), "feature_id")
    top = clustered.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    return top.groupBy("cluster_key", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "feature_id"))), lambda s: s["feature_id"]).alias("members"))
