"""Incremental processing: each file once, running totals, budgets, late events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_files(spark: SparkSession, folder: str, schema: T.StructType, form: str = "parquet", most_files: int = 10) -> DataFrame:
    """A stream of a folder's files, at most ``most_files`` at a time; the checkpoint remembers which are done."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", most_files).load(folder)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Processes what is there and ends. ``each`` gets a batch and its number; it must be idempotent per number."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def once_per_key(df: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Events without repeats of a key within the time that late ones may take."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(df: DataFrame, at: str, by: list[str], width: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per window and key; windows close when the watermark passes."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return df.withWatermark(at, late).groupBy(w, *by).agg(F.count("*").alias("n"))


def within_budget(df: DataFrame, order: list[str], spent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows that a call budget still allows, in order, and the rest with the reason."""
    allowed = df.orderBy(*order).limit(max(0, most - spent))
    rest = df.join(allowed.select(*order), order, "left_anti").withColumn("reason", F.lit("budget_exhausted"))
    return allowed, rest
