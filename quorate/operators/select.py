"""Batches, shards, quotas and plans of calls over tables of any size."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorate.functions.keys import stripped
from quorate.operators.ranks import ranked, running_total
from quorate.operators.sampling import hash_order


def paired_batches(df: DataFrame, side: str, order: Sequence[str], size: int, name: str = "batch_id") -> DataFrame:
    """Batches with ``size`` rows of each side, numbered from 0; rows beyond the batches that all sides fill drop out."""
    d = ranked(df, [side], order, "__r", "__n")
    whole = d.groupBy(side).agg(F.floor(F.max("__n") / size).alias("w")).agg(F.min("w").alias("__w"))  # one row
    d = d.withColumn(name, F.floor((F.col("__r") - 1) / size).cast("int")).join(F.broadcast(whole), F.lit(True))
    return d.where(F.col(name) < F.col("__w")).select(*df.columns, name)


def sized_shards(df: DataFrame, group: str, key: str, size: str, most: int, name: str = "shard") -> DataFrame:
    """Rows of each group, in the order of ``key``, in shards (from 0) of at most ``most``; a larger row is a shard of its own.

    A group's rows stream through one task in sorted batches; only the running
    shard is held, so a group may be of any size.
    """
    rest = [f for f in df.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, shard = None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b[group], b[size], strict=True):
                if now is None or g != now[0]:
                    now, held, shard = (g,), int(n), 0
                elif held + int(n) > most:
                    held, shard = int(n), shard + 1
                else:
                    held += int(n)
                out.append(shard)
            yield b.assign(**{name: pd.Series(out, index=b.index, dtype="int32")})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{name}` int"])
    return df.repartition(group).sortWithinPartitions(group, key).mapInPandas(run, schema)


def even_quotas(total: int, names: Sequence[str]) -> dict[str, int]:
    """``total`` shared evenly; what is left goes to the first names, one each."""
    each, left = divmod(total, len(names))
    return {n: each + (i < left) for i, n in enumerate(names)}


def waterfall(df: DataFrame, key: str, tier: str, source: str, sources: tuple[str, str, str], n: int, seed: int) -> DataFrame:
    """``n`` rows of each tier: from the first source, the rest half and half from the other two, each filling in for the other."""
    a, b, c = sources
    count = lambda s: F.count_if(F.col(source) == s)
    q = df.groupBy(F.col(tier).alias("__t")).agg(count(a).alias("a"), count(b).alias("b"), count(c).alias("c"))  # one row per tier
    q = q.withColumn("qa", F.least(F.lit(n), F.col("a"))).withColumn("rest", F.lit(n) - F.col("qa"))
    q = q.withColumn("b1", F.least("b", F.floor(F.col("rest") / 2))).withColumn("c1", F.least("c", F.col("rest") - F.col("b1")))
    q = q.withColumn("qb", F.least("b", F.col("b1") + F.greatest(F.lit(0), F.col("rest") - F.col("b1") - F.col("c1"))))
    q = q.withColumn("qc", F.least("c", F.col("c1") + F.greatest(F.lit(0), F.col("rest") - F.col("qb") - F.col("c1"))))
    d = ranked(df.withColumn("__h", hash_order(seed, key)), [tier, source], ["__h", key], "__r").join(q.select("__t", "qa", "qb", "qc"), F.col(tier).eqNullSafe(F.col("__t")))
    quota = F.when(F.col(source) == a, F.col("qa")).when(F.col(source) == b, F.col("qb")).when(F.col(source) == c, F.col("qc")).otherwise(0)
    return d.where(F.col("__r") <= quota).select(*df.columns)


def balanced_split(df: DataFrame, key: str, label: str, share: float, seed: int) -> DataFrame:
    """Adds ``split`` (train, test) to as many random rows of each class as the rarest has."""
    d = ranked(df.withColumn("__h", hash_order(seed, key)), [label], ["__h", key], "__r", "__n")
    least = d.groupBy(label).agg(F.max("__n").alias("n")).agg(F.min("n").alias("__m"))  # one row
    d = d.join(F.broadcast(least), F.lit(True)).where(F.col("__r") <= F.col("__m"))
    return d.withColumn("split", F.when(F.col("__r") <= F.floor(F.col("__m") * share + 1e-9), "train").otherwise("test")).select(*df.columns, "split")


def learning_curve(df: DataFrame, key: str, by: Sequence[str], fractions: Sequence[float], seed: int) -> DataFrame:
    """Rows of training and test of each class for every fraction; the smaller training sets are part of the larger."""
    d = ranked(df.withColumn("__h", hash_order(seed, key)), by, ["__h", key], "__r", "__n")
    cells = [F.struct(F.lit(float(f)).alias("fraction"), F.count_if(F.col("__r") <= F.floor(F.col("__n") * f + 1e-9)).alias("n_train"), F.count_if(F.col("__r") > F.floor(F.col("__n") * f + 1e-9)).alias("n_test")) for f in fractions]
    return d.groupBy(*by).agg(F.array(*cells).alias("x")).select(*by, F.explode("x").alias("x")).select("x.fraction", *by, "x.n_train", "x.n_test")


def swapped(key: str, seed: int) -> Column:
    """A fair coin for each key that every engine throws alike."""
    return F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") % 2 == 1


def response_issues(asked: DataFrame, answered: DataFrame, key: str) -> DataFrame:
    """(key, issue) of every id: ``missing``, ``unknown``, ``duplicate`` or ``ok``."""
    a = asked.select(key).where(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    r = answered.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return a.join(r, key, "full").select(key, F.when(F.col("n").isNull(), "missing").when(F.col("a").isNull(), "unknown").when(F.col("n") > 1, "duplicate").otherwise("ok").alias("issue"))


def require_answers(asked: DataFrame, answered: DataFrame, key: str) -> None:
    """An error that names some of the ids that are not in order."""
    bad = response_issues(asked, answered, key).where("issue != 'ok'").limit(5).collect()
    if bad:
        raise ValueError(f"responses out of order: {[tuple(r) for r in bad]}")


def apportion(needs: DataFrame, need: str, order: Sequence[str], budget: int) -> DataFrame:
    """Adds ``granted`` and ``refused``: the budget goes to the rows in order, each as much as it needs while it lasts."""
    d = running_total(needs, order, [need], "__")
    left = F.lit(budget) - (F.col(f"__{need}") - F.col(need))
    granted = F.greatest(F.least(F.col(need), left), F.lit(0))
    return d.withColumn("granted", granted).withColumn("refused", F.col(need) - granted).drop(f"__{need}")


def repeated(df: DataFrame, lists: str, name: str, n: str) -> DataFrame:
    """Ids that are in more than one row's list; null ids count for nothing."""
    ids = df.select(F.explode(F.array_distinct(F.filter(lists, lambda x: x.isNotNull()))).alias(name))
    return ids.groupBy(name).agg(F.count("*").alias(n)).where(F.col(n) > 1)


def excluded_ids(document: Column, name: str = "ids") -> Column:
    """Ids out of JSON that is a list of them, or an object with such a list; null if it is neither."""
    of_object = F.from_json(document, f"struct<{name}: array<string>>")[name]
    return F.coalesce(F.from_json(document, "array<string>"), of_object)


def pilot_trials(df: DataFrame) -> DataFrame:
    """Moderation trials of a phase above 0, the phase as a number, without attitude columns."""
    keep = [c for c in df.columns if not c.startswith("attitude_")]
    d = df.select(*keep).where(F.col("trial_type") == "moderation-trial").withColumn("phase", stripped("phase").try_cast("double"))
    return d.where("phase > 0")


def without_empty_columns(df: DataFrame) -> DataFrame:
    """The table without columns that are null throughout, by one aggregation."""
    n = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if n[c]])


def unified(sources: Mapping[str, tuple[DataFrame, Mapping[str, Column]]], name: str) -> DataFrame:
    """Rows of several tables, each by its own column mapping, under the name of their source; a column that one lacks is null."""
    out = None
    for source, (df, columns) in sources.items():
        part = df.select(F.lit(source).alias(name), *[c.alias(n) for n, c in columns.items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def calls_cost(calls: int, tokens_in: float, tokens_out: float, prices: tuple[float, float]) -> float:
    """Cost of a number of calls of a mean size, prices being for a million tokens in and out."""
    return calls * (tokens_in * prices[0] + tokens_out * prices[1]) / 1e6
