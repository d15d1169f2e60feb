"""Files as DataFrames: the binary scan, format dispatch and one row per source feature.

Each file is parsed in one task, because a document or archive can only be read from its start; files
spread over tasks.  A file that is rejected becomes a row with its failure and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..model import FORMATS, SOURCE_FEATURE, Limits
from .common import Dataset, FileFailure, bounded, compact
from .kml import read_kml
from .shapefile import read_shapefile

HEADER_INDEX = -1


def format_of(path: Column) -> Column:
    """KML or SHAPEFILE by the suffix, whatever its case; null for anything else."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(suffix == ".kml", "KML").when(suffix == ".zip", "SHAPEFILE")


def scan_files(spark: SparkSession, *paths: str, limits: Limits = Limits()) -> DataFrame:
    """path, length, modificationTime, content, format and sha256 of every file below ``paths``.

    Files beyond the size limit are listed with null content; theirs is never read, as the length
    filter reaches the scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    names = ["path", "length", "modificationTime"]
    fine = files.where(F.col("length") <= limits.upload_bytes).select(*names, "content", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > limits.upload_bytes).select(*names, F.lit(None).cast("binary").alias("content"), F.lit(None).cast("string").alias("sha256"))
    return fine.unionByName(large).withColumn("format", format_of(F.col("path")))


def read_dataset(content: bytes | None, kind: str | None, limits: Limits = Limits(), length: int | None = None) -> Dataset:
    """The dataset of one file's bytes; raises FileFailure where the file is rejected.

    ``length``: the file's size, where its content was not read because of it.
    """
    if kind not in FORMATS:
        raise FileFailure("UNSUPPORTED_FORMAT", "The file is neither KML nor a zipped Shapefile.", 415)
    if max(len(content or b""), length or 0) > limits.upload_bytes:
        raise FileFailure("UPLOAD_TOO_LARGE", "The file is too large.")
    if not content:
        raise FileFailure("INVALID_DATASET", "The file is empty.")
    return read_kml(content, limits) if kind == "KML" else read_shapefile(content, limits)


def _rows(path: str, kind: str | None, content: bytes | None, length: int, limits: Limits) -> Iterator[dict]:
    """A file's features and, last, its header: where reading fails midway, the header says so and voids the rows."""
    header = dict.fromkeys((f.name for f in SOURCE_FEATURE)) | {"path": path, "format": kind, "feature_index": HEADER_INDEX}
    try:
        data = read_dataset(content, kind, limits, length)
        for i, f in enumerate(data.features):
            yield {
                "path": path, "format": kind, "feature_index": i, "source_id": f.source_id, "geometry_type": f.geometry_type, "dimensions": f.dimensions,
                "geometry": None if f.geometry is None else compact(f.geometry), "source_parts": None if f.source_parts is None else json.dumps(f.source_parts),
                "properties": compact(f.properties), "metadata": compact(f.metadata), "crs_wkt": data.crs_wkt, "source_coordinates": f.coordinates, "extra_work": f.extra_work,
                "preset_status": f.status, "issues": bounded(f.issues, limits), "file_failure": None, "file_http_status": None, "file_message": None, "file_warnings": None, "deleted_records": None,
            }
        yield header | {"crs_wkt": data.crs_wkt, "file_warnings": data.warnings, "deleted_records": data.deleted}
    except FileFailure as why:
        yield header | {"file_failure": why.code, "file_http_status": why.http_status, "file_message": str(why)}
    except Exception:
        yield header | {"file_failure": "INVALID_DATASET", "file_http_status": 422, "file_message": "The dataset could not be read."}


BATCH_ROWS, BATCH_BYTES = 200, 16 << 20


def _batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number and size, across files."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(len(row[c]) for c in ("geometry", "source_parts", "properties", "metadata") if row[c])
        if len(kept) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(kept, schema)
            kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema)


def read_features(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One header row per file (feature_index -1) and one row per feature of the readable files.

    Features leave in batches while the file is read; those of a file whose header has a failure are void.
    """
    schema = to_arrow_schema(SOURCE_FEATURE)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            paths, kinds, lengths = (batch.column(i).to_pylist() for i in range(3))
            for i, (path, kind, length) in enumerate(zip(paths, kinds, lengths, strict=True)):
                yield from _rows(path, kind, batch.column(3)[i].as_py(), int(length), limits)

    within = F.when(F.col("length") <= limits.upload_bytes, F.col("content"))
    return files.select("path", "format", "length", within.alias("content")).mapInArrow(lambda batches: _batches(rows(batches), schema), SOURCE_FEATURE)
