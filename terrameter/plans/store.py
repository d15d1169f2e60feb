"""Published tables: files and features, pages over them, and delete.

Features are written first and the files' rows last, so these are the commit marker: readers semi-join
``files``, and features without a row there are invisible leftovers.  Each publication writes its
features to a folder of its own (``run``), in as many buckets by a hash of the file as its rows need; the
file's row says where they are.  So a publication reads back its own rows only, and a page reads one
bucket.  The files' rows of a publication appear together, by the renaming of one folder (atomic where
the file system's rename is), and a frame over them keeps to the folders that were there when it was made.

Small runs are put together by ``compact``: their features are written again as one run, and then their
files' rows, with a later ``seq``; of the rows of one id the latest counts, so readers see one or the
other.  ``clean`` removes the runs that no row names any more.  Files are partitioned by the day of their
creation, so a page reads days from the newest on, and carry a Bloom filter on their id for lookups.
"""

from __future__ import annotations

import base64
import json
import time
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..model import MEASUREMENT_STATUSES, STORED_FEATURE, STORED_FILE, Limits
from ..sources.common import FileFailure

ROWS_PER_BUCKET = 500_000
ROWS_PER_TASK = 125_000  # that write a bucket
MOST_BUCKETS = 4096


def _bucket(file_id: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(file_id), buckets).cast("int")


class StoreError(Exception):
    def __init__(self, code: str, message: str, http_status: int) -> None:
        super().__init__(message)
        self.code, self.http_status = code, http_status


def file_checks() -> dict[str, Column]:
    """Constraints of a files row by name."""
    counts = [F.col(c) for c in ("measured_count", "not_applicable_count", "unsupported_count", "error_count")]
    complete = (F.col("status") == "COMPLETED") & F.col("feature_count").isNotNull() & (F.col("feature_count") == sum(counts[1:], counts[0])) & F.col("failure_code").isNull()
    failed = (F.col("status") == "FAILED") & F.col("feature_count").isNull() & F.col("failure_code").isNotNull()
    return {"format": F.col("format").isin("KML", "SHAPEFILE"), "status": F.col("status").isin("COMPLETED", "FAILED"), "upload_size": F.col("upload_size") > 0, "terminal_counts": F.coalesce(complete, F.lit(False)) | F.coalesce(failed, F.lit(False))}


def feature_checks() -> dict[str, Column]:
    """Constraints of a features row by name; NaN and infinities fail the finite check."""
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")))
    one = F.col("area_m2").isNotNull() != F.col("length_m").isNotNull()
    none = F.col("area_m2").isNull() & F.col("length_m").isNull()
    measured = F.col("measurement_status") == "MEASURED"
    return {
        "index": F.col("feature_index") >= 0,
        "status": F.col("measurement_status").isin(MEASUREMENT_STATUSES),
        "consistency": F.when(measured, one & F.col("provenance").isNotNull()).otherwise(none),
        "finite": finite("area_m2") & finite("length_m"),
    }


def checked(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``rows``, failing the write on the first row that breaks a constraint."""
    broken = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return rows.withColumn("_ok", F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("constraint "), broken))).otherwise(F.lit(True))).where("_ok").drop("_ok")


class Store:
    """Files and features below one folder."""

    def __init__(self, spark: SparkSession, root: str, limits: Limits = Limits()) -> None:
        self.spark, self.root, self.limits = spark, root.rstrip("/"), limits

    def _exists(self, name: str) -> bool:
        path, fs = self._fs(name)
        return bool(fs.exists(path))

    def remove(self, name: str) -> None:
        """Delete a folder of the store, such as a used staging folder."""
        path, fs = self._fs(name)
        fs.delete(path, True)

    def _deleted(self) -> DataFrame:
        if not self._exists("deleted"):
            return self.spark.createDataFrame([], "id string")
        return self.spark.read.schema("id string").parquet(f"{self.root}/deleted")

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> dict[str, int]:
        """Names of the folders in a folder of the store, with their times in seconds."""
        path, fs = self._fs(name)
        return {s.getPath().getName(): s.getModificationTime() // 1000 for s in fs.listStatus(path) if s.isDirectory()} if self._exists(name) else {}

    def _file_rows(self) -> DataFrame:
        """The latest row of each id, deleted ones included."""
        if not any(name.startswith("run=") for name in self._folders("files")):
            return self.spark.createDataFrame([], STORED_FILE)
        rows = self.spark.read.schema(STORED_FILE).parquet(f"{self.root}/files")
        # what all rows of an id have in common is a key, so that filters on it reach the scan
        same = ["id", "created_at", "day"]
        latest = rows.groupBy(*same).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in same]), "seq").alias("latest"))
        return latest.select("latest.*", *same).select(*rows.columns)

    def files(self) -> DataFrame:
        return self._file_rows().join(self._deleted(), "id", "left_anti")

    def features(self) -> DataFrame:
        """Features of the files that are published and not deleted."""
        files = self.files().where("status = 'COMPLETED'").select(F.col("id").alias("file_id"), "run")  # listed first: what they name is there
        if not self._exists("features"):
            return self.spark.createDataFrame([], STORED_FEATURE)
        rows = self.spark.read.schema(STORED_FEATURE).parquet(f"{self.root}/features")
        return rows.join(files, ["file_id", "run"], "left_semi").select(*STORED_FEATURE.names)

    def publish(self, manifests: DataFrame, features: DataFrame, ids: DataFrame) -> None:
        """Append features, then the files' rows; ``ids``: path, id, filename, upload_size, sha256, created_at.

        An identical second run adds rows with new ids only; features that were written without their
        file stay invisible.  Give ``process_files`` a staging folder: both frames are read twice here.
        """
        promised = manifests.agg(F.sum("feature_count")).first()[0] or 0
        rows = features.join(ids.select("path", F.col("id").alias("file_id")), "path").drop("path", "format", "crs_wkt")
        run, buckets = self._write_features(checked(rows, feature_checks()), int(promised))
        # what was written must be what the manifests promise, or no file row appears
        counts = self._run(run).groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("_written"))
        done = manifests.join(ids, "path").join(counts, "id", "left").withColumn("completed_at", F.current_timestamp()).drop("path")
        same = (F.col("status") == "FAILED") & F.col("_written").isNull() | (F.coalesce("_written", F.lit(0)) == F.col("feature_count"))
        self._show_files(checked(checked(done, {"published_count": same}).drop("_written"), file_checks()), run, buckets)

    def _write_features(self, rows: DataFrame, n: int) -> tuple[str, int]:
        """A new run of about ``n`` features, not yet visible: its name and its buckets."""
        run = f"r{uuid.uuid4().hex}"
        buckets = max(1, min(MOST_BUCKETS, -(-n // ROWS_PER_BUCKET)))
        rows = rows.withColumn("bucket", _bucket(F.col("file_id"), F.lit(buckets)))
        # a file's rows stay in one task, and no two buckets meet in one
        tasks = max(1, -(-n // (buckets * ROWS_PER_TASK)))
        task = F.col("bucket") * tasks + F.pmod(F.xxhash64("file_id", F.lit("task")), F.lit(tasks)).cast("int")
        # a job of its own folder: writers at once share no temporary files
        rows.repartitionById(buckets * tasks, task).sortWithinPartitions("bucket", "file_id", "feature_index").write.partitionBy("bucket").parquet(f"{self.root}/features/run={run}")
        return run, buckets

    def _show_files(self, rows: DataFrame, run: str, buckets: int) -> None:
        """Make files' rows visible, all at once: they are written aside, and their folder gets its name last."""
        aside = f"_new-{run}"  # readers pass over names with this beginning
        rows = rows.withColumns({"buckets": F.lit(buckets), "seq": F.lit(time.time_ns()), "day": F.to_date("created_at")})
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in STORED_FILE if f.name != "run"])
        bloom = {"parquet.bloom.filter.enabled#id": "true", "parquet.bloom.filter.expected.ndv#id": "100000"}
        rows.repartition("day").sortWithinPartitions("day", "created_at", "id").write.options(**bloom).partitionBy("day").parquet(f"{self.root}/files/{aside}")
        (source, fs), (target, _) = self._fs(f"files/{aside}"), self._fs(f"files/run={run}")
        if not fs.rename(source, target):
            raise StoreError("PUBLICATION_FAILED", "The files' rows could not be made visible.", 500)

    def compact(self, most_rows: int = ROWS_PER_BUCKET, most_runs: int = 1000) -> int:
        """Put runs of fewer features than ``most_rows``, and runs with deleted files, together; how many were.

        At most ``most_runs`` a call.  A file that is deleted or put together by someone else meanwhile
        keeps its state: ids stay deleted, and of two copies the later counts.
        """
        live = self.files()
        by_run = live.groupBy("run").agg(F.sum(F.coalesce("feature_count", F.lit(0))).alias("n"))
        whole = self._file_rows().join(self._deleted(), "id", "left_semi").select("run").distinct().withColumn("has_deleted", F.lit(True))
        found = by_run.join(whole, "run", "left").where((F.col("n") < most_rows) | F.col("has_deleted")).orderBy("n", "run").limit(most_runs).collect()
        runs = [r["run"] for r in found]
        if len(runs) < 2 and not any(r["has_deleted"] for r in found):
            return 0
        rows = live.where(F.col("run").isin(runs))
        own = self.spark.read.schema(STORED_FEATURE).parquet(f"{self.root}/features").where(F.col("run").isin(runs)) if self._exists("features") else self.spark.createDataFrame([], STORED_FEATURE)
        own = own.join(rows.select(F.col("id").alias("file_id"), "run"), ["file_id", "run"], "left_semi").drop("run", "bucket")
        run, buckets = self._write_features(own, sum(r["n"] for r in found))
        self._show_files(rows.drop("run"), run, buckets)
        return len(runs)

    def clean(self, grace_seconds: int = 86_400) -> int:
        """Remove runs without a row that counts, once they are older than any reader or writer that may use them."""
        before = int(time.time()) - grace_seconds
        folders = {f"{table}/{name}": at for table in ("files", "features") for name, at in self._folders(table).items()}
        used = {r["run"] for r in self.files().select("run").distinct().collect()}
        old = [path for path, at in folders.items() if at <= before and path.rsplit("/", 1)[1].removeprefix("run=").removeprefix("_new-") not in used]
        for path in old:
            self.remove(path)
        return len(old)

    def _run(self, run: str, bucket: int | None = None) -> DataFrame:
        """Features of one publication, or of one of its buckets: nothing else is listed."""
        path = f"features/run={run}" + ("" if bucket is None else f"/bucket={bucket}")
        if not self._exists(path):
            return self.spark.createDataFrame([], STORED_FEATURE)
        return self.spark.read.option("basePath", f"{self.root}/features").schema(STORED_FEATURE).parquet(f"{self.root}/{path}")

    def delete(self, file_id: str) -> None:
        """Hide a file and, with it, its features; ``vacuum`` removes the rows."""
        self.require(file_id)
        self.spark.createDataFrame([(file_id,)], "id string").write.mode("append").parquet(f"{self.root}/deleted")

    def vacuum(self, root: str) -> Store:
        """A copy of the store below ``root`` without deleted files and features that no file owns."""
        self.features().write.partitionBy("run", "bucket").parquet(f"{root}/features")
        self.files().write.partitionBy("run", "day").parquet(f"{root}/files")
        return Store(self.spark, root, self.limits)

    def require(self, file_id: str, completed: bool = False):
        """The file's row; 404 if it is missing, 409 if it failed but must be complete."""
        row = self.files().where(F.col("id") == file_id).limit(1).first()
        if row is None:
            raise StoreError("FILE_NOT_FOUND", "The file does not exist.", 404)
        if completed and row["status"] == "FAILED":
            raise StoreError("FILE_PROCESSING_FAILED", "The file could not be processed.", 409)
        return row

    def list_files(self, limit: int = 20, cursor: str | None = None) -> tuple[DataFrame, str | None]:
        """(rows, next cursor): newest first, by creation time and id."""
        if not 1 <= limit <= 100:
            raise ValueError("limit must be from 1 to 100")
        after, files, found = None if cursor is None else decode_cursor(cursor), self.files(), []
        for day in self._days():
            if len(found) > limit:
                break
            own = files.where(F.col("day") == F.lit(day).cast("date")) if day else files.where("day is null")
            found += keyset_page(own, limit - len(found), after).collect()
        rows = self.spark.createDataFrame(found[:limit], files.schema)
        return rows, encode_cursor(found[limit - 1]["created_at"], found[limit - 1]["id"]) if len(found) > limit else None

    def _days(self) -> list[str | None]:
        """Days with files, the newest first, by the names of their folders."""
        path, fs = self._fs("files/run=*/day=*")
        names = {s.getPath().getName().removeprefix("day=") for s in fs.globStatus(path) or []}
        return [*sorted((n for n in names if not n.startswith("__")), reverse=True), *[None for n in names if n.startswith("__")]]

    def feature_page(self, file_id: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int, int | None]:
        """(rows in feature order, total count, next offset)."""
        if not 1 <= limit <= 200 or offset < 0:
            raise ValueError("limit must be from 1 to 200 and offset not negative")
        own = self._own(self.require(file_id, completed=True))
        count = own.count()
        return own.orderBy("feature_index").offset(offset).limit(limit), count, offset + limit if offset + limit < count else None

    def _own(self, owner: Row) -> DataFrame:
        """A file's features, from its bucket."""
        bucket = self.spark.range(1).select(_bucket(F.lit(owner["id"]), F.lit(owner["buckets"]))).first()[0]
        return self._run(owner["run"], bucket).where(F.col("file_id") == owner["id"])

    def measurement_page(self, file_id: str, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int, int | None]:
        rows, count, after = self.feature_page(file_id, limit, offset)
        url = F.concat(F.lit(f"/api/files/{file_id}/features/"), F.col("feature_index").cast("string"), F.lit("/"))
        return rows.select("feature_index", "source_id", "geometry_type", *measurement_payload(), url.alias("detail_url")), count, after

    def feature(self, file_id: str, feature_index: int):
        """One feature with its file's CRS; 404 if it is missing."""
        owner = self.require(file_id, completed=True)
        if feature_index < 0:
            raise StoreError("REQUEST_VALIDATION_ERROR", "The index must not be negative.", 404)
        row = self._own(owner).where(F.col("feature_index") == feature_index).withColumn("source_crs_wkt", F.lit(owner["crs_wkt"])).limit(1).first()
        if row is None:
            raise StoreError("FEATURE_NOT_FOUND", "The feature does not exist.", 404)
        return row


def keyset_page(files: DataFrame, limit: int, after: tuple[datetime, str] | None = None) -> DataFrame:
    """``limit`` rows and one more, newest first, strictly after a (created_at, id) position."""
    if after is not None:
        at = F.lit(after[0])
        files = files.where((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < after[1])))
    return files.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)


def encode_cursor(created_at: datetime, file_id: str) -> str:
    at = created_at if created_at.tzinfo else created_at.replace(tzinfo=UTC)
    raw = json.dumps({"created_at": at.isoformat(), "id": file_id}, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    """(created_at, id) of a cursor; exactly these keys, with a time zone."""
    try:
        if len(cursor) > 1024:
            raise ValueError("too long")
        value = json.loads(base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True))
        if set(value) != {"created_at", "id"} or not isinstance(value["id"], str):
            raise ValueError("keys")
        at = datetime.fromisoformat(value["created_at"])
        if at.tzinfo is None:
            raise ValueError("no time zone")
        return at.astimezone(UTC), value["id"]
    except (ValueError, TypeError) as why:
        raise StoreError("INVALID_CURSOR", "The cursor is invalid.", 422) from why


def measurement_payload() -> list[Column]:
    """kind, value, unit, method, policy, edge_model, dimension and component_count of a measurement."""
    area, length = F.col("area_m2").isNotNull(), F.col("length_m").isNotNull()
    return [
        F.col("measurement_status").alias("status"),
        F.when(area, "area").when(length, "length").alias("kind"),
        F.coalesce("area_m2", "length_m").alias("value"),
        F.when(area, "m2").when(length, "m").alias("unit"),
        F.col("provenance.method").alias("method"),
        F.coalesce("provenance.measurement_policy", F.lit("local-geodesic-v1")).alias("policy"),
        F.col("provenance.edge_model").alias("edge_model"),
        F.coalesce("provenance.dimension", F.lit(2)).alias("dimension"),
        F.coalesce(F.size("provenance.components"), F.lit(0)).alias("component_count"),
    ]


def failure_record(code: Column, message: Column, details: Column, limits: Limits = Limits()) -> Column:
    """A bounded failure: code to 80 and message to 500 characters, details to 8 KiB or omitted."""
    return F.struct(
        F.substring(code, 1, 80).alias("code"), F.substring(message, 1, 500).alias("message"), F.when(F.octet_length(details) > 8192, F.lit('{"omitted":true}')).otherwise(details).alias("details")
    )


def http_status(code: Column) -> Column:
    """413 for exhausted limits, else 422."""
    return F.when(code.endswith("_LIMIT"), 413).otherwise(422)


def write_feature_lines(features: DataFrame, path: str, limits: Limits = Limits()) -> None:
    """One dataset as JSON Lines in feature order, nulls written out; the committer makes the folder appear whole.

    Lines, their sum and the generated work are checked first; FileFailure says which limit is broken.
    What passes is one bounded file, so one task writes it.
    """
    line = F.to_json(F.struct(*features.columns), {"ignoreNullFields": "false"})
    rows = features.select("feature_index", line.alias("value"), *([F.col("provenance")] if "provenance" in features.columns else []))
    size = F.octet_length("value") + 1
    counter = lambda c: F.sum(F.greatest(F.coalesce(F.col(f"provenance.{c}"), F.lit(0)), F.lit(0)))
    work = [counter("generated_coordinates_final"), counter("generated_coordinates_total")] if "provenance" in features.columns else [F.lit(0), F.lit(0)]
    n, ids, low, high, longest, total, final, all_work = rows.agg(
        F.count("*"), F.count_distinct("feature_index"), F.min("feature_index"), F.max("feature_index"), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(size), F.lit(0)), *work
    ).first()
    if n and (ids, low, high) != (n, 0, n - 1):
        raise FileFailure("PROCESSOR_PROTOCOL_ERROR", "The features are not in order.")
    for found, most, code in (
        (final or 0, limits.generated_file_coordinates, "FILE_GENERATED_COORDINATE_LIMIT"), (all_work or 0, limits.generated_work, "FILE_GENERATED_WORK_LIMIT"),
        (longest, limits.feature_json_bytes, "FEATURE_OUTPUT_LIMIT"), (total, limits.output_bytes, "FILE_OUTPUT_LIMIT"),
    ):
        if found > most:
            raise FileFailure(code, "The dataset exceeds a limit of its output.")
    rows.repartition(1).sortWithinPartitions("feature_index").select("value").write.mode("overwrite").text(path)
