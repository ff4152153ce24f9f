"""Staged tables: lineage cut by a written table in the shared folder.

An iterative plan must not recompute its past and must survive the loss of an
executor, so intermediate results go to Parquet files under the folder that
``spark.checkpoint.dir`` names. Only on a local master without that setting
(tests, a laptop) a temporary folder is used; on a cluster it must be set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Folder for staged tables of this application."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/quorate-{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="quorate-")
        atexit.register(shutil.rmtree, _FALLBACK[app], True)
    return _FALLBACK[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written files.

    The scan gets the schema of ``df``, so no inference job runs. Columns of
    void type are not supported by Parquet and must be cast before.
    """
    path = f"{staging_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    spark = df.sparkSession
    root = staging_root(spark)
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.rsplit("/", 1)[-1] not in name:
            continue
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
