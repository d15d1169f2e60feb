"""Projections of the tables for readers: summaries, links, CRS, errors and checks of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ISSUE, POLICY, PROVENANCE, Limits


def links(file_id: Column) -> Column:
    base = F.concat(F.lit("/api/files/"), file_id, F.lit("/"))
    return F.struct(base.alias("self"), F.concat(base, F.lit("measurements/")).alias("measurements"), F.concat(base, F.lit("features/")).alias("features"))


def crs_summary(authority: Column, name: Column, wkt: Column) -> Column:
    """Authority, name and WKT; null without a name and WKT, and a name stands in for an empty one."""
    known = F.coalesce(name, F.lit("")) != ""
    return F.when(known | (F.coalesce(wkt, F.lit("")) != ""), F.struct(authority.alias("authority"), F.when(known, name).otherwise(F.lit("Unknown source CRS")).alias("name"), wkt.alias("wkt")))


def file_summary() -> list[Column]:
    """Columns of a file's summary; a failed file has a failure and no counters."""
    failure = F.when(F.col("failure_code").isNotNull(), F.struct(F.col("failure_code").alias("code"), F.col("failure_message").alias("message")))
    counters = ["feature_count", "measured_count", "not_applicable_count", "unsupported_count", "error_count", "deleted_record_count"]
    return [F.col("id"), F.col("filename"), F.col("format"), F.col("status"), F.col("created_at"), F.col("completed_at"), *map(F.col, counters), F.col("has_issues"), F.col("warnings"), failure.alias("failure"), links(F.col("id")).alias("links")]


def feature_summary(measurement: list[Column]) -> list[Column]:
    """Columns of a feature's summary, its measurement nested without its status."""
    nested = F.struct(*measurement[1:])
    return [F.col("feature_index"), F.col("source_id"), F.col("geometry_type"), F.col("dimensions"), F.col("measurement_status").alias("status"), nested.alias("measurement"), F.col("properties"), F.col("issues")]


def compact_work(provenance: Column) -> Column:
    """What stays of the provenance of a feature that is not measured: the policy and the total work."""
    kept = {"policy": F.coalesce(provenance["policy"], F.lit(POLICY)), "generated_coordinates_total": F.nullif(F.greatest(provenance["generated_coordinates_total"], F.lit(0)), F.lit(0))}
    return F.when(provenance.isNotNull(), F.struct(*[kept.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PROVENANCE]))


def error_body(code: Column, message: Column, details: Column, request_id: Column) -> Column:
    return F.struct(F.struct(code.alias("code"), message.alias("message"), details.alias("details"), request_id.alias("request_id")).alias("error"))


def filename_problem(name: Column, limits: Limits = Limits()) -> Column:
    """INVALID_FILENAME or FILENAME_TOO_LONG, or null for a usable name."""
    bad = name.isNull() | (name == "") | (F.instr(name, "\0") > 0) | ~F.is_valid_utf8(name)
    return F.when(bad, "INVALID_FILENAME").when(F.octet_length(name) > limits.filename_bytes, "FILENAME_TOO_LONG")


def create_table_statements(catalog: str, location: str) -> list[str]:
    """DDL of both tables over a store's folder."""
    issue, provenance = ISSUE.simpleString(), PROVENANCE.simpleString()
    return [
        f"CREATE TABLE IF NOT EXISTS {catalog}.features (feature_index INT, source_id STRING, geometry_type STRING, dimensions INT, geometry STRING, source_parts STRING, properties STRING, metadata STRING, "
        f"measurement_status STRING, area_m2 DOUBLE, length_m DOUBLE, provenance {provenance}, issues ARRAY<{issue}>, file_id STRING, run STRING, bucket INT) USING parquet PARTITIONED BY (run, bucket) LOCATION '{location}/features'",
        f"CREATE TABLE IF NOT EXISTS {catalog}.files (format STRING, status STRING, crs_wkt STRING, feature_count BIGINT, measured_count BIGINT, not_applicable_count BIGINT, unsupported_count BIGINT, error_count BIGINT, "
        f"deleted_record_count INT, has_issues BOOLEAN, warnings ARRAY<{issue}>, failure_code STRING, failure_message STRING, http_status INT, measurement_policy STRING, id STRING, filename STRING, upload_size BIGINT, "
        f"sha256 STRING, created_at TIMESTAMP, completed_at TIMESTAMP, buckets INT, seq BIGINT, run STRING, day DATE) USING parquet PARTITIONED BY (run, day) LOCATION '{location}/files'",
    ]
