"""What lies in a folder: keys, latest files and runs, inventories, manifests, and files that need care to read."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.operators.validate import require_columns
from quorate.sources.catalog import csv, file_kind, file_month

#: Time stamps of runs and exports in names.
STAMP = re.compile(r"\d{4}_\d{2}_\d{2}-\d{2}:\d{2}:\d{2}")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def keys(spark: SparkSession, folder: str, prefix: str = "", recursive: bool = True) -> list[str]:
    """Paths of the files below a folder whose relative path begins with ``prefix``, in lexical order; any Hadoop file system."""
    root, fs = _fs(spark, folder)
    if not fs.exists(root):
        return []
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    found, it = [], fs.listFiles(root, recursive)
    while it.hasNext():
        path = it.next().getPath().toString()
        if path[len(base) :].startswith(prefix):
            found.append(path)
    return sorted(found)


def read_object(spark: SparkSession, path: str) -> bytes:
    """The bytes of one small file."""
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def write_object(spark: SparkSession, data: bytes, path: str) -> None:
    """Writes one small file whole: under another name first, then renamed."""
    target, fs = _fs(spark, path)
    draft, _ = _fs(spark, path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"cannot write {path}")


#: Content types by suffix.
CONTENT_TYPES = {"csv": "text/csv", "json": "application/json", "jsonl": "application/x-ndjson", "parquet": "application/vnd.apache.parquet", "png": "image/png", "txt": "text/plain", "md": "text/markdown"}


def content_type(path: str) -> str:
    return CONTENT_TYPES.get(path.rsplit(".", 1)[-1].lower(), "application/octet-stream")


def latest_file(paths: Sequence[str], stamp: re.Pattern = STAMP) -> tuple[str, str]:
    """The file with the greatest time stamp in its name, and the stamp; an error if no name has one."""
    dated = [(m.group(), p) for p in paths if (m := stamp.search(p.rsplit("/", 1)[-1]))]
    if not dated:
        raise FileNotFoundError("no file with a time stamp")
    when, path = max(dated)
    return path, when


def latest_run(spark: SparkSession, folder: str, complete: str | None = None) -> str:
    """The folder's last time-stamped subfolder; with ``complete`` the last that holds such a file, if any does."""
    root, fs = _fs(spark, folder)
    runs = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and STAMP.fullmatch(s.getPath().getName().replace("%3A", ":"))) if fs.exists(root) else []
    if not runs:
        raise FileNotFoundError(f"no run in {folder}")
    whole = [r for r in runs if complete and fs.exists(_fs(spark, f"{folder}/{r}/{complete}")[0])]
    return f"{folder}/{(whole or runs)[-1]}"


def inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, kind, month and size_mb of the files below a folder, as a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), file_kind(name).alias("kind"), file_month(name).alias("month"), F.round(F.col("length") / 1048576, 2).alias("size_mb"))


def inputs(spark: SparkSession, folder: str, prefixes: Sequence[str] = (), ignored: Sequence[str] = ()) -> list[str]:
    """Comment archives below a folder, in order: those of the given stem prefixes and without the ignored stems."""
    stem = lambda p: p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return [p for p in keys(spark, folder) if re.fullmatch(r"RC_.*\.zst", p.rsplit("/", 1)[-1]) and stem(p) not in ignored and (not prefixes or stem(p).startswith(tuple(prefixes)))]


def row_counts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path and rows of parquet files, from their footers; a file that cannot be read has null."""
    rows = []
    for p in paths:  # one footer a file: driver work in the number of files
        try:
            rows.append((p, spark.read.parquet(p).count()))
        except Exception:  # noqa: BLE001  a broken file is a row of the inventory
            rows.append((p, None))
    return spark.createDataFrame(rows, "path string, rows long")


def month_path(root: str, month: str) -> str:
    """Where the comments of a month lie, in the layout of partition discovery."""
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(f"no month: {month}")
    return f"{root.rstrip('/')}/month={month}"


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Rows of the exports that the metadata.json of each integration's folder names, with ``integration``; a missing export is an error."""
    out, (top, fs) = None, _fs(spark, root)
    base = fs.makeQualified(top).toString().rstrip("/") + "/"
    for path in [k for k in keys(spark, root) if k.endswith("/metadata.json")]:
        folder = path.rsplit("/", 1)[0]
        export = f"{folder}/{json.loads(read_object(spark, path))['export_file']}"
        if not fs.exists(_fs(spark, export)[0]):
            raise FileNotFoundError(export)
        part = csv(spark, export).withColumn("integration", F.lit(path[len(base) :].split("/")[0]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no metadata.json below {root}")
    return out


def json_folder(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """Records of a folder's JSON files but metadata.json, with ``source_file``; an empty folder is an error."""
    names = [k for k in keys(spark, folder, recursive=False) if k.endswith(".json") and not k.endswith("/metadata.json")]
    if not names:
        raise ValueError(f"no JSON files in {folder}")
    return spark.read.schema(schema).option("multiLine", True).json(names).withColumn("source_file", F.col("_metadata.file_name"))


def predictions(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines with the given columns; missing columns, null keys and repeated keys are errors."""
    raw = spark.read.json(path)
    require_columns(raw, schema.fieldNames())
    d = spark.read.schema(schema).json(path)
    bad = d.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(5).collect()
    if bad:
        raise ValueError(f"null or repeated keys: {[r[0] for r in bad]}")
    return d


def payload(c: Column, schema: str) -> Column:
    """JSON in a string, also where the string itself was written as JSON once more; null if it is neither."""
    inner = F.get_json_object(F.concat(F.lit('{"x":'), c, F.lit("}")), "$.x")
    return F.from_json(F.when(c.startswith('"'), inner).otherwise(c), schema)


def csv_after_preamble(spark: SparkSession, path: str, head: str) -> DataFrame:
    """A CSV whose header is the first line that begins with ``head``, whatever stands before it."""
    lines = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", rf"(?ms)^({re.escape(head)}.*)\z", 1).alias("t"))
    text = lines.first()["t"]
    if not text:
        raise ValueError(f"no line begins with {head}")
    rows = text.splitlines()  # one report: it was read as one value
    return spark.read.option("header", True).csv(spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).rdd.map(lambda r: r[0]))


def latex_rows(c: Column) -> Column:
    r"""Rows of LaTeX arrays in a text: cells between ``&``, rows ended by ``\\``, without rules and the column line."""
    body = F.regexp_extract_all(c, F.lit(r"(?s)\\begin\{array\}\{[^}]*\}(.*?)\\end\{array\}"), 1)
    rows = F.split(F.regexp_replace(F.array_join(body, "\\\\"), r"\\hline", ""), r"\\\\")
    plain = lambda x: F.trim(F.regexp_replace(x, r"\\text(?:bf)?\{([^}]*)\}", "$1"))
    return F.filter(F.transform(rows, lambda r: F.transform(F.split(F.trim(r), "&"), plain)), lambda r: F.size(r) > 1)


def matrix(spark: SparkSession, npy: str, ids: Sequence[str], size: int) -> DataFrame:
    """id and vector of a saved matrix of one small run; another number of rows or columns than expected is an error."""
    m = np.load(io.BytesIO(read_object(spark, npy)))
    if m.ndim != 2 or m.shape != (len(ids), size):
        raise ValueError(f"matrix of {m.shape}, expected {(len(ids), size)}")
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, m, strict=True)], "id string, vector array<double>")


def archive_lines(spark: SparkSession, paths: Sequence[str], window: int = 31) -> DataFrame:
    """path and line of zstd archives with long windows, which the built-in reader refuses; blank lines drop out.

    Each archive streams through one task; lines leave it in Arrow batches.
    """
    import zstandard

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(path.removeprefix("file:"), "rb") as f:
                    reader = io.TextIOWrapper(zstandard.ZstdDecompressor(max_window_size=1 << window).stream_reader(f, read_across_frames=True), "utf-8", "replace")
                    held: list[str] = []
                    for line in reader:
                        if line.strip():
                            held.append(line.rstrip("\n"))
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held)], names=["path", "line"])
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(held)), pa.array(held)], names=["path", "line"])

    return files.mapInArrow(run, "path string, line string")


class KeyValues:
    """A key-value table in a folder: made when missing, read and written by key, the last write of a key counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def ensure(self) -> None:
        p, fs = _fs(self.spark, self.path)
        if not fs.exists(p):
            self.spark.createDataFrame([], f"{self.schema}, __at long").write.parquet(self.path)

    def scan(self) -> DataFrame:
        """All rows, the last of each key."""
        self.ensure()
        d = self.spark.read.schema(f"{self.schema}, __at long").parquet(self.path)
        rest = [c for c in d.columns if c not in (self.key, "__at")]
        last = d.groupBy(self.key).agg(F.max_by(F.struct(*rest), "__at").alias("r"))
        return last.select(self.key, *[F.col(f"r.{c}").alias(c) for c in rest])

    def put(self, rows: DataFrame) -> None:
        """Adds or replaces rows by key."""
        self.ensure()
        p, fs = _fs(self.spark, self.path)
        at = len(fs.listStatus(p))  # every write adds files, so later ones have a higher number
        rows.withColumn("__at", F.lit(at).cast("long")).write.mode("append").parquet(self.path)

    def get(self, value: str):
        """The row of a key, None without one."""
        return self.scan().where(F.col(self.key) == value).first()
