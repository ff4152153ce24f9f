"""Writers: refusing, appending, atomic, partitioned, compacting; chat records, run metadata, Markdown tables."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorate.sources.discover import keys, read_object, write_object


def write(df: DataFrame, path: str, force: bool = False, form: str = "parquet", by: list[str] | None = None) -> None:
    """Writes a folder; an existing one is an error unless ``force``. An empty table keeps its schema."""
    w = df.write.mode("overwrite" if force else "errorifexists").format(form)
    (w.partitionBy(*by) if by else w).save(path)


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Adds rows to a folder; a part file appears whole or not at all."""
    df.write.mode("append").format(form).options(header=True).save(path)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows without those that ``new`` replaces, and the new ones."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def chat(system: Column, user: Column, assistant: Column) -> Column:
    """The three messages of a training record."""
    m = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(m("system", system), m("user", user), m("assistant", assistant))


def write_chat(df: DataFrame, key: str, system: str, user: str, assistant: str, path: str, force: bool = False) -> None:
    """JSON lines of key and messages."""
    rows = df.select(F.col(key).alias("message_id"), chat(F.lit(system), F.col(user), F.col(assistant)).alias("messages"))
    rows.write.mode("overwrite" if force else "errorifexists").json(path)


def export_lines(df: DataFrame, columns: Mapping[str, str], folder: str, force: bool = False) -> int:
    """JSON lines under other names (new name -> column) in zstd archives, one a partition; null fields are left out. Gives the rows.

    ``folder`` is one that all executors share as a path. An archive is written
    under a name of its attempt and then renamed, so that a repeated or lost
    task leaves a whole one.
    """
    if os.path.isdir(folder) and os.listdir(folder) and not force:
        raise FileExistsError(folder)
    os.makedirs(folder, exist_ok=True)
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    lines = df.select(F.to_json(F.struct(*[F.col(c).alias(n) for n, c in columns.items()])).alias("line"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        part = f"{folder}/part-{task.partitionId():05d}.jsonl.zst"
        draft, n = f"{part}.{task.taskAttemptId()}", 0
        with open(draft, "wb") as f, zstandard.ZstdCompressor().stream_writer(f) as z:
            for b in batches:
                for line in b.column(0).to_pylist():
                    z.write(line.encode() + b"\n")
                    n += 1
        if n:
            os.replace(draft, part)
        else:
            os.remove(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return int(lines.mapInArrow(archive, "n long").agg(F.sum("n")).first()[0] or 0)


def merged_metadata(total: Mapping | None, stem: str, rows: int, reason: str | None = None) -> dict:
    """Cumulative metadata with a file's rows; the same file again replaces its entry, so a repeated run changes nothing."""
    files = {**(total or {}).get("files", {}), stem: rows}
    return {"files": files, "total": sum(files.values()), "stopped_reason": reason or (total or {}).get("stopped_reason")}


def write_metadata(spark: SparkSession, path: str, stem: str, rows: int, reason: str | None = None) -> dict:
    """Merges a file's rows into the metadata at ``path``, which is replaced whole."""
    here = [k for k in keys(spark, path.rsplit("/", 1)[0], recursive=False) if k.endswith("/" + path.rsplit("/", 1)[-1])]
    total = merged_metadata(json.loads(read_object(spark, path)) if here else None, stem, rows, reason)
    write_object(spark, json.dumps(total, sort_keys=True).encode(), path)
    return total


def compact(spark: SparkSession, folder: str, to: str, schema: str, remove: bool = False) -> int:
    """Many small JSON files as one table of JSON lines; the sources go only after the copy was counted. Gives its rows."""
    sources = [k for k in keys(spark, folder, recursive=False) if k.endswith(".json") and not k.endswith("/metadata.json")]
    d = spark.read.schema(schema).option("multiLine", True).json(sources)
    d.write.mode("overwrite").json(to)
    n = spark.read.schema(schema).json(to).count()
    if n != d.count():
        raise OSError(f"{to} is not a full copy")
    if remove:
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        for s in sources:
            p = fs.Path(s)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, False)
    return n


def write_matrix(df: DataFrame, key: str, vector: str, folder: str, metadata: Mapping) -> int:
    """A run's vectors as .npy, ids and metadata, in the order of the keys; for runs that fit one file. Gives their number."""
    rows = df.select(key, vector).orderBy(key).collect()
    data = io.BytesIO()
    np.save(data, np.array([r[1] for r in rows], dtype=np.float64))
    spark = df.sparkSession
    write_object(spark, data.getvalue(), f"{folder}/vectors.npy")
    write_object(spark, "\n".join(str(r[0]) for r in rows).encode(), f"{folder}/ids.txt")
    write_object(spark, json.dumps({**metadata, "n": len(rows)}, sort_keys=True).encode(), f"{folder}/metadata.json")
    return len(rows)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A small result as a Markdown table: fractions with ``digits`` decimals, null as a dash."""
    cell = lambda v: "–" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = f"| {' | '.join(df.columns)} |\n|{' --- |' * len(df.columns)}"
    return "\n".join([head, *(f"| {' | '.join(cell(v) for v in r)} |" for r in df.collect())])


def between_marks(document: str, name: str, table: str) -> str:
    """The document with the text between its marks ``<!-- name:begin -->`` and ``<!-- name:end -->`` replaced; missing marks are an error."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if begin not in document or end not in document:
        raise ValueError(f"no marks for {name}")
    head, rest = document.split(begin, 1)
    return f"{head}{begin}\n{table}\n{end}{rest.split(end, 1)[1]}"


def grid(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> str:
    """A partition grid for a console: one line a row value, one column a column value."""
    wide = df.groupBy(row).pivot(column, list(columns)).agg(F.first(value)).orderBy(row)
    rows = [[str(v) if v is not None else "-" for v in r] for r in wide.collect()]
    width = [max(len(x) for x in c) for c in zip(wide.columns, *rows, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width, strict=True)).rstrip() for line in [wide.columns, *rows])
