"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine; 0 where either vector is zero; an error where the lengths differ."""
    size = F.size(_c(a)) == F.size(_c(b))
    value = F.when(norm(a) * norm(b) > 0, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))
    return F.when(size, value).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def unit(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))


def dense_block(a: Column | str, b: Column | str) -> Column:
    """Both vectors, the absolute difference, the product and the cosine, in one array."""
    apart = F.transform(difference(a, b), F.abs)
    product = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.concat(_c(a).cast("array<double>"), _c(b).cast("array<double>"), apart, product, F.array(cosine(a, b)))


def closed_bin(x: Column | str, low: float, high: float, bins: int) -> Column:
    """Equal-width bin 1..bins of a value in [low, high], the last bin closed above; else null."""
    v = _c(x)
    inside = (v >= low) & (v <= high)
    return F.when(inside, F.least(F.lit(bins), F.floor((v - low) / ((high - low) / bins)).cast("int") + 1))


def right_closed_bin(x: Column | str, bins: int) -> Column:
    """Bin 1..bins of a probability, closed on the right: 0.0 falls outside every bin."""
    v = _c(x)
    return F.when((v > 0) & (v <= 1), F.ceil(v * bins).cast("int"))


def with_cosine(a: Column | str, b: Column | str) -> Column:
    """Both vectors and their cosine, in one array."""
    return F.concat(_c(a).cast("array<double>"), _c(b).cast("array<double>"), F.array(cosine(a, b)))


def equivalent(a: Column | str, b: Column | str, tolerance: float) -> Column:
    """Whether two vectors have one length and differ by at most ``tolerance`` everywhere."""
    return (F.size(_c(a)) == F.size(_c(b))) & F.forall(difference(a, b), lambda x: F.abs(x) <= tolerance)


def density(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n and density of a value over equal bins of [low, high]; values outside and null count for nothing."""
    n = df.groupBy(closed_bin(value, low, high, bins).alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")
    # At most ``bins`` rows.
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.select("bin", "n", F.round(F.col("n") / (whole * ((high - low) / bins)), 6).alias("density"))
