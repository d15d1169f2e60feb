"""Folders for intermediate tables, below the one that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_used: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; it is removed at exit.

    Where that setting is empty, a local session gets a temporary folder; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="terrameter-"))
        base = f"file://{_own[0]}"
    path = f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"
    _used.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _used:
        try:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        except Exception:  # the session is gone; the folder's owner cleans it
            return
