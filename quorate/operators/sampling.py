"""Samples and splits that every engine can repeat: rows ordered by a hash of seed and key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quorate.operators.ranks import ranked


def hash_order(seed: int, key: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, or all there are."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def frozen(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """A subset that is drawn once: read from ``path`` if it is there, else made and written. Also whether it was made."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS"))
    if not there:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), not there


def per_class(df: DataFrame, key: str, by: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each class, or all it has."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, key), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def share_per_class(df: DataFrame, key: str, by: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """ceil(fraction x n) rows of each class."""
    d = ranked(df.withColumn("__h", hash_order(seed, key)), by, ["__h", key], "__r", "__n").drop("__h")
    return d.where(F.col("__r") <= F.ceil(F.col("__n") * fraction)).drop("__r", "__n")


def split(df: DataFrame, key: str, by: Sequence[str], parts: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Adds ``split``: each class is cut at floor(cumulated share x n); the last part takes the rest."""
    d = ranked(df.withColumn("__h", hash_order(seed, key)), by, ["__h", key], "__r", "__n").drop("__h")
    name, upto = F.lit(parts[-1][0]), 0.0
    cuts = []
    for part, share in parts[:-1]:
        upto += share
        cuts.append((part, upto))
    for part, cut in reversed(cuts):
        name = F.when(F.col("__r") <= F.floor(F.col("__n") * cut + 1e-9), part).otherwise(name)
    return d.withColumn("split", name).drop("__r", "__n")
