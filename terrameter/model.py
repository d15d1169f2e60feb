"""Limits, schemas and codes of the measuring engine."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POLICY = "local-geodesic-v1"

# Enumerations.
FORMATS = ["KML", "SHAPEFILE"]
FILE_STATUSES = ["COMPLETED", "FAILED"]
MEASUREMENT_STATUSES = ["MEASURED", "NOT_APPLICABLE", "UNSUPPORTED", "ERROR"]
SEVERITIES = ["warning", "error"]


@dataclass(frozen=True)
class Limits:
    """Every budget of one file, one feature and one component."""

    upload_bytes: int = 10 * 1024 * 1024
    expanded_bytes: int = 50 * 1024 * 1024
    archive_entries: int = 64
    features: int = 5_000
    file_coordinates: int = 100_000
    feature_coordinates: int = 20_000
    generated_feature_coordinates: int = 100_000
    generated_file_coordinates: int = 500_000
    generated_work: int = 2_000_000
    feature_json_bytes: int = 2 * 1024 * 1024
    filename_bytes: int = 255
    output_bytes: int = 64 * 1024 * 1024
    xml_depth: int = 64
    xml_elements: int = 250_000
    xml_text: int = 65_536
    geometry_bytes: int = 1024 * 1024
    property_bytes: int = 64 * 1024
    metadata_bytes: int = 1024 * 1024
    issues: int = 20
    components: int = 128
    radius_m: float = 100_000.0
    start_segment_m: float = 500.0
    refinements: int = 5
    extent_subdivisions: int = 100_000
    json_depth: int = 32
    json_values: int = 1_000_000
    manifest_bytes: int = 256 * 1024


ISSUE = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "message", "severity", "details")])
CENTER = T.StructType([T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType())])
COMPONENT = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("component_count", T.IntegerType()),
        T.StructField("center", CENTER),
        T.StructField("projection", T.StringType()),
        T.StructField("edge_model", T.StringType()),
        T.StructField("maximum_segment_m", T.DoubleType()),
        T.StructField("refinements", T.IntegerType()),
        T.StructField("generated_coordinates", T.LongType()),
        T.StructField("stable_transitions", T.IntegerType()),
    ]
)
PROVENANCE = T.StructType(
    [
        T.StructField("policy", T.StringType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("edge_model", T.StringType()),
        T.StructField("source_crs_wkt", T.StringType()),
        T.StructField("source_to_wgs84", T.StringType()),
        T.StructField("components", T.ArrayType(COMPONENT)),
        T.StructField("generated_coordinates_total", T.LongType()),
        T.StructField("generated_coordinates_final", T.LongType()),
        T.StructField("method", T.StringType()),
        T.StructField("measurement_policy", T.StringType()),
    ]
)
MEASUREMENT = T.StructType(
    [
        T.StructField("measurement_status", T.StringType()),
        T.StructField("area_m2", T.DoubleType()),
        T.StructField("length_m", T.DoubleType()),
        T.StructField("provenance", PROVENANCE),
        T.StructField("issues", T.ArrayType(ISSUE)),
    ]
)
PROPERTY = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
CRS_INFO = T.StructType([T.StructField(n, T.StringType()) for n in ("authority", "name", "wkt")])

#: A feature as the readers give it: geometry and metadata as JSON text, properties in order.
SOURCE_FEATURE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("feature_index", T.IntegerType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("geometry_type", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
        T.StructField("geometry", T.StringType()),
        T.StructField("source_parts", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("crs_wkt", T.StringType()),
        T.StructField("source_coordinates", T.LongType()),
        T.StructField("extra_work", T.LongType()),
        T.StructField("preset_status", T.StringType()),
        T.StructField("issues", T.ArrayType(ISSUE)),
        T.StructField("file_failure", T.StringType()),
        T.StructField("file_http_status", T.IntegerType()),
        T.StructField("file_message", T.StringType()),
        T.StructField("file_warnings", T.ArrayType(ISSUE)),
        T.StructField("deleted_records", T.IntegerType()),
    ]
)

#: A published feature's row.
STORED_FEATURE = T.StructType(
    [
        T.StructField("feature_index", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("source_id", "geometry_type")],
        T.StructField("dimensions", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("geometry", "source_parts", "properties", "metadata", "measurement_status")],
        *[T.StructField(n, T.DoubleType()) for n in ("area_m2", "length_m")],
        T.StructField("provenance", PROVENANCE),
        T.StructField("issues", T.ArrayType(ISSUE)),
        T.StructField("file_id", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)

STORED_FILE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("format", "status", "crs_wkt")],
        *[T.StructField(n, T.LongType()) for n in ("feature_count", "measured_count", "not_applicable_count", "unsupported_count", "error_count")],
        T.StructField("deleted_record_count", T.IntegerType()),
        T.StructField("has_issues", T.BooleanType()),
        T.StructField("warnings", T.ArrayType(ISSUE)),
        *[T.StructField(n, T.StringType()) for n in ("failure_code", "failure_message")],
        T.StructField("http_status", T.IntegerType()),
        *[T.StructField(n, T.StringType()) for n in ("measurement_policy", "id", "filename")],
        T.StructField("upload_size", T.LongType()),
        T.StructField("sha256", T.StringType()),
        *[T.StructField(n, T.TimestampType()) for n in ("created_at", "completed_at")],
        T.StructField("buckets", T.IntegerType()),
        T.StructField("seq", T.LongType()),
        T.StructField("run", T.StringType()),
        T.StructField("day", T.DateType()),
    ]
)
