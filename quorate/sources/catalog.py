"""Named tables, files of several formats, and what their names tell."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the name of an uploaded file.
UPLOAD = r"^data_(\d+)(?:_[0-9a-f]+)?\.csv$"

COMMENT = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("author", T.StringType()), ("link_id", T.StringType()), ("parent_id", T.StringType()), ("subreddit", T.StringType()), ("body", T.StringType()), ("score", T.LongType()), ("created_utc", T.LongType()), ("permalink", T.StringType()))])


@dataclass(frozen=True)
class Entry:
    """A table of a study: where it lies, its kind (results, stimuli, transformed) and the study's phase."""

    path: str
    kind: str = "results"
    phase: str = ""


#: The tables of the moderation study by name.
STUDY = {
    "trials": Entry("trials.parquet", "results", "phase 2 part 2"),
    "cohort": Entry("four_cell_cohort.parquet", "transformed", "phase 2 part 2"),
    "splits": Entry("split_ids.parquet", "transformed", "phase 2 part 2"),
    "flips": Entry("flips.parquet", "stimuli", "mirrors"),
    "comments": Entry("comments.parquet", "stimuli", "dumps"),
    "synced_comments": Entry("mirrorview_comments.parquet", "stimuli", "dumps"),
    "toxicity_scores": Entry("toxicity_scores.parquet", "transformed", "dumps"),
    "features": Entry("assignments_hdbscan.parquet", "transformed", "features"),
}


class Catalog:
    """Names of tables and where they lie; an unknown name is an error that lists the known ones. Relative paths lie below ``root``."""

    def __init__(self, entries: Mapping[str, str | Entry], root: str = ""):
        self.entries = {n: e if isinstance(e, Entry) else Entry(e) for n, e in entries.items()}
        self.root = root.rstrip("/")

    def entry(self, name: str) -> Entry:
        if name not in self.entries:
            raise KeyError(f"unknown table {name}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name]

    def path(self, name: str) -> str:
        """The table's path; whether it exists is not looked at."""
        p = self.entry(name).path
        return p if not self.root or "://" in p or p.startswith("/") else f"{self.root}/{p}"

    def names(self, kind: str | None = None, phase: str | None = None) -> list[str]:
        return sorted(n for n, e in self.entries.items() if kind in (None, e.kind) and phase in (None, e.phase))

    def load(self, spark: SparkSession, name: str) -> DataFrame:
        path = self.path(name)
        if path.endswith(".csv"):
            return csv(spark, path)
        return spark.read.json(path) if ".json" in path else spark.read.parquet(path)


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, lines: bool = False, infer: bool = False) -> DataFrame:
    """CSV with a header and doubled quotes; quoted fields may hold line ends.

    Without a schema all columns are strings, or with ``infer`` what their
    values look like. With ``lines`` no field holds a line end, and large files
    are read in parts.
    """
    reader = spark.read.options(header=True, multiLine=not lines, escape='"', inferSchema=infer)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType = COMMENT, key: str = "id") -> DataFrame:
    """JSON lines, compressed or not; lines that are no record of the schema are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.col(key).isNotNull())


def uploaded_at(name: Column) -> Column:
    """Milliseconds in an uploaded file's name, null for other files."""
    return F.regexp_extract(name, UPLOAD, 1).try_cast("long")


def uploads_since(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """Rows of the uploads of a UTC day or later, with ``source_file``; older files are not opened."""
    start = F.unix_millis(F.to_timestamp(F.lit(day)))
    d = csv(spark, f"{folder}/data_*.csv")
    return d.withColumn("source_file", F.col("_metadata.file_name")).where(uploaded_at(F.col("_metadata.file_name")) >= start)


def without_bad_files(df: DataFrame, file: str, bad: Column) -> DataFrame:
    """Drops every row of a file in which ``bad`` holds anywhere."""
    files = df.where(bad).select(file).distinct()
    return df.join(files, file, "left_anti")


def file_kind(name: Column) -> Column:
    """comment_zst, submission_zst, comment_parquet, submission_parquet, parquet_other or other, by a file's name in any case."""
    n = F.lower(name)
    table = F.when(n.contains("comment"), "comment_parquet").when(n.contains("submission"), "submission_parquet").otherwise("parquet_other")
    zst = n.endswith(".zst")
    return F.when(zst & n.startswith("rc_"), "comment_zst").when(zst & n.startswith("rs_"), "submission_zst").when(n.endswith(".parquet"), table).otherwise("other")


def file_month(name: Column) -> Column:
    """The month after RC_ or RS_ in a file's name, null without one."""
    m = F.regexp_extract(name, r"(?:RC|RS)_(\d{4}-\d{2})", 1)
    return F.when(m != "", m)
