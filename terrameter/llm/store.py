"""Shared folder, written intermediate tables and bounded Arrow batches.

Intermediate tables are Parquet files below ``spark.checkpoint.dir``, the folder that every executor
sees, so a lost executor costs only a re-read.  Where that setting is empty, a local session (tests on
one machine) gets a temporary folder of its own; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one in a local session where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="terrameter-"))
    return f"file://{_own[0]}"


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def drop(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned; its readers must be done."""
    path = getattr(df, "_terrameter_path", None)
    if path:
        jpath, fs = _filesystem(df.sparkSession, path)
        fs.delete(jpath, True)
        _written[:] = [x for x in _written if x[1] != path]


def written(df: DataFrame) -> DataFrame:
    """Run ``df`` once, keep it as Parquet in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/terrameter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._terrameter_path = path
    return out


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            jpath, fs = _filesystem(spark, path)
            fs.delete(jpath, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            return


def bounded_batches(spark: SparkSession, rows: int = 500) -> None:
    """Keep Arrow batches small: a batch ends at ``rows`` rows or at Spark's maxBytesPerBatch (64 MB),
    whichever comes first.  The bytes bound memory; the rows keep batches of short texts small too.

    Spark reads the row setting when a plan runs, so it stays set for the session's later queries.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
