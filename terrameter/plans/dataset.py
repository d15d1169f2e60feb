"""Files to measured features and manifests.

Reading, measuring and the feature cascade are row-wise.  One shuffle by file orders its features for
the running budgets; the first feature that breaks one decides the file's failure.  Manifests are one
grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..model import ISSUE, POLICY, Limits
from ..operators.measure import measurement
from ..sources.files import HEADER_INDEX, read_features
from .views import compact_work

UNSUPPORTED_CODES = ["UNSUPPORTED_GEOMETRY", "UNSUPPORTED_SHAPE_TYPE"]


def component_count(geometry: Column) -> Column:
    """Parts of a GeoJSON text: one for simple types, the list's length for multipart ones."""
    kind = F.get_json_object(geometry, "$.type")
    parts = F.json_array_length(F.get_json_object(geometry, "$.coordinates"))
    return F.when(kind.startswith("Multi"), parts).when(kind.isin("Point", "LineString", "Polygon"), 1).otherwise(0)


def _errors(pairs: list[tuple[Column, Column]]) -> Column:
    found = [F.when(test, F.array(problem)).otherwise(F.array().cast(f"array<{ISSUE.simpleString()}>")) for test, problem in pairs]
    return F.concat(*found)


def normalised(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Features with oversized payloads taken out, and ``status`` where the cascade already decides it.

    The order matters: a reader's error, an unsupported type, an oversized payload, too many
    components; only what is left is measured.
    """
    error = lambda code, message: expr.issue(code, message, "error")
    big = {
        "source_id": F.length("source_id") > 255,
        "geometry": F.octet_length("geometry") > limits.geometry_bytes,
        "source_parts": F.octet_length("source_parts") > limits.geometry_bytes,
        "properties": F.octet_length("properties") > limits.property_bytes,
        "metadata": F.octet_length("metadata") > limits.metadata_bytes,
    }
    big = {k: F.coalesce(v, F.lit(False)) for k, v in big.items()}
    oversized = _errors(
        [
            (big["source_id"], error("SOURCE_ID_LIMIT", "The source id is too long.")),
            (big["geometry"], error("SOURCE_GEOMETRY_LIMIT", "The geometry is too large.")),
            (big["source_parts"], error("SOURCE_PARTS_LIMIT", "The source parts are too large.")),
            (big["properties"], error("PROPERTY_LIMIT_EXCEEDED", "The properties are too large.")),
            (big["metadata"], error("SOURCE_METADATA_LIMIT", "The metadata is too large.")),
        ]
    )
    rows = features.withColumns({"_oversized": oversized, "_parts": component_count(F.col("geometry"))})
    many = F.coalesce(F.col("_parts") > limits.components, F.lit(False))
    has_error = F.exists("issues", lambda i: i["severity"] == "error")
    has_unsupported = F.exists("issues", lambda i: i["code"].isin(UNSUPPORTED_CODES))
    status = F.coalesce(
        F.col("preset_status"), F.when(has_error, "ERROR").when(has_unsupported, "UNSUPPORTED").when(F.size("_oversized") > 0, "ERROR").when(many, "ERROR")
    )
    too_many = F.when(F.col("preset_status").isNull() & ~has_error & ~has_unsupported & (F.size("_oversized") == 0) & many, F.array(error("COMPONENT_LIMIT", "The feature has too many components."))).otherwise(
        F.array().cast(f"array<{ISSUE.simpleString()}>")
    )
    rows = rows.withColumns({"status": status, "issues": F.concat("issues", "_oversized", too_many)})
    return rows.withColumns(
        {
            "source_id": F.when(~big["source_id"], F.col("source_id")),
            "geometry_type": F.substring("geometry_type", 1, 32),
            "geometry": F.when(~big["geometry"] & ~many, F.col("geometry")),
            "source_parts": F.when(~big["source_parts"], F.col("source_parts")),
            "properties": F.when(big["properties"], F.lit("[]")).otherwise(F.col("properties")),
            "metadata": F.when(big["metadata"], F.lit("{}")).otherwise(F.col("metadata")),
        }
    ).drop("_oversized", "_parts")


def measured(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Normalised features with their measurement; decided features are not measured again."""
    open_ = F.col("status").isNull()
    rows = features.withColumn("_m", measurement(F.when(open_, F.col("geometry")), F.col("crs_wkt"), limits))
    status = F.when(open_, F.col("_m.measurement_status")).otherwise(F.col("status"))
    issues = expr.truncated_issues(F.when(open_, F.concat("issues", F.col("_m.issues"))).otherwise(F.col("issues")), limits)
    value = lambda c: F.when(open_, F.col(f"_m.{c}"))
    return rows.select(
        "path", "format", "feature_index", "source_id", "geometry_type", F.coalesce("dimensions", F.lit(2)).alias("dimensions"), "geometry", "source_parts", "properties", "metadata",
        status.alias("measurement_status"), value("area_m2").alias("area_m2"), value("length_m").alias("length_m"), value("provenance").alias("provenance"),
        expr.with_severity(issues, status).alias("issues"), F.coalesce("extra_work", F.lit(0)).alias("extra_work"), "crs_wkt",
    )


_PAYLOADS = {"source_parts": None, "geometry": None, "properties": "[]", "metadata": "{}"}


def shrunk(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Features whose JSON line is too large become errors without measurement, then lose payloads until they fit.

    Of the provenance the policy and the work stay, as the work counts toward the file's budget.
    """
    shown = [c for c in features.columns if c not in ("path", "format", "extra_work", "crs_wkt")]
    line = lambda of: expr.json_size(F.struct(*[of.get(c, F.col(c)).alias(c) for c in shown])) + 1
    problem = F.array(expr.issue("FEATURE_OUTPUT_LIMIT", "The feature's record is too large.", "error"))
    plain = {
        "measurement_status": F.lit("ERROR"), "area_m2": F.lit(None).cast("double"), "length_m": F.lit(None).cast("double"), "provenance": compact_work(F.col("provenance")),
        "issues": expr.with_severity(expr.truncated_issues(F.concat("issues", problem), limits), F.lit("ERROR")),
    }
    rows = features.withColumn("output_bytes", line({}))
    over = F.col("output_bytes") > limits.feature_json_bytes
    rows = rows.withColumn("_left", F.when(over, line(plain)))
    left, dropped = F.col("_left"), {}
    for c, blank in _PAYLOADS.items():
        size = lambda v: expr.json_size(F.struct(v.alias("x")))
        too_much = over & (left > limits.feature_json_bytes)
        dropped[c] = F.when(too_much, F.lit(blank)).otherwise(F.col(c))
        left = F.when(too_much, left - size(F.col(c)) + size(F.lit(blank).cast("string"))).otherwise(left)
    out = rows.withColumns({**dropped, **{c: F.when(over, v).otherwise(F.col(c)) for c, v in plain.items()}, "output_bytes": F.when(over, left).otherwise(F.col("output_bytes"))})
    return out.withColumn("over_limit", F.col("output_bytes") > limits.feature_json_bytes).drop("_left")


def with_running_budgets(features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Running totals of a file's features in order, and the budget that each row is the first to break."""
    order = Window.partitionBy("path").orderBy("feature_index").rowsBetween(Window.unboundedPreceding, 0)
    counter = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    final = counter("provenance.generated_coordinates_final")
    work = counter("provenance.generated_coordinates_total") + counter("extra_work")
    rows = features.withColumns({"run_final": F.sum(final).over(order), "run_work": F.sum(work).over(order), "run_bytes": F.sum("output_bytes").over(order)})
    return rows.withColumn(
        "breach",
        F.when((F.col("run_final") > limits.generated_file_coordinates) | (F.col("run_work") > limits.generated_work), "GENERATED_COORDINATE_LIMIT").when(F.col("over_limit"), "FEATURE_OUTPUT_LIMIT").when(F.col("run_bytes") > limits.output_bytes, "CHILD_OUTPUT_LIMIT"),
    )


def status_counts() -> list[Column]:
    is_ = lambda s: F.count_if(F.col("measurement_status") == s)
    return [is_("MEASURED").alias("measured_count"), is_("NOT_APPLICABLE").alias("not_applicable_count"), is_("UNSUPPORTED").alias("unsupported_count"), is_("ERROR").alias("error_count")]


def manifests(headers: DataFrame, features: DataFrame) -> DataFrame:
    """One terminal row per file: counters and CRS if completed, the failure if not."""
    totals = features.groupBy("path").agg(
        F.count("*").alias("feature_count"), *status_counts(), F.bool_or(F.size("issues") > 0).alias("_issues"), F.min(F.when(F.col("breach").isNotNull(), F.struct("feature_index", "breach")))["breach"].alias("_breach")
    )
    rows = headers.join(totals, "path", "left")
    failure = F.coalesce("file_failure", "_breach")
    done = failure.isNull()
    counts = ["feature_count", "measured_count", "not_applicable_count", "unsupported_count", "error_count"]
    warnings = F.coalesce("file_warnings", F.array().cast(f"array<{ISSUE.simpleString()}>"))
    return rows.select(
        "path", "format", F.when(done, "COMPLETED").otherwise("FAILED").alias("status"), F.when(done, F.col("crs_wkt")).alias("crs_wkt"),
        *[F.when(done, F.coalesce(c, F.lit(0))).alias(c) for c in counts], F.when(done, F.coalesce("deleted_records", F.lit(0))).alias("deleted_record_count"),
        (~done | (F.size(warnings) > 0) | F.coalesce("_issues", F.lit(False)) | (F.coalesce(F.col("unsupported_count") + F.col("error_count"), F.lit(0)) > 0)).alias("has_issues"),
        F.when(done, warnings).alias("warnings"), failure.alias("failure_code"),
        F.when(~done, F.coalesce("file_message", F.lit("A budget of the file is exhausted."))).alias("failure_message"),
        F.when(~done, F.coalesce("file_http_status", F.lit(413))).alias("http_status"), F.lit(POLICY).alias("measurement_policy"),
    )


def _kept(rows: DataFrame, staging: str | None, name: str) -> DataFrame:
    """``rows``, or their copy below the staging folder, so that what follows does not run them again."""
    if staging is None:
        return rows
    rows.write.parquet(f"{staging}/{name}")
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{staging}/{name}")


def process_files(files: DataFrame, limits: Limits = Limits(), staging: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifests, features) of scanned files; a failed file keeps no features.

    Both results come from the same parse and measurement.  With a ``staging`` folder (shared by all
    executors, removed by the caller) each of these runs once, whatever is done with the results.
    """
    rows = _kept(read_features(files, limits), staging, "source")
    headers = rows.where(F.col("feature_index") == HEADER_INDEX).select("path", "format", "crs_wkt", "file_failure", "file_message", "file_http_status", "file_warnings", "deleted_records")
    features = rows.where(F.col("feature_index") != HEADER_INDEX)  # those that had left before their file failed go with its manifest, below
    budgeted = _kept(with_running_budgets(shrunk(measured(normalised(features, limits), limits), limits), limits), staging, "features")
    found = _kept(manifests(headers, budgeted), staging, "manifests")
    kept = budgeted.join(found.where("status = 'COMPLETED'").select("path"), "path", "left_semi")
    return found, kept.drop("run_final", "run_work", "run_bytes", "breach", "over_limit", "output_bytes", "extra_work")
