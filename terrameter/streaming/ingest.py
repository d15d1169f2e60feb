"""New files are measured and published as they arrive, a bounded number at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Limits
from ..plans.dataset import process_files
from ..plans.store import Store
from ..sources.files import scan_files


def start_ingest(spark: SparkSession, folder: str, store: Store, checkpoint: str, files_per_batch: int = 64, limits: Limits = Limits()) -> StreamingQuery:
    """A query that publishes every new file below ``folder`` once and stops when none is left.

    A file's id is a hash of its path and content, so a batch that runs again after a failure appends
    nothing that is already published.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def publish(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # files_per_batch at most
        if not paths:
            return
        files = scan_files(spark, *paths, limits=limits)
        staging = f"staging/{number}"
        store.remove(staging)  # of an attempt that failed
        ids = files.select(
            "path", F.sha2(F.concat_ws("|", "path", F.coalesce("sha256", F.col("length").cast("string"))), 256).alias("id"), F.element_at(F.split("path", "/"), -1).alias("filename"),
            F.col("length").alias("upload_size"), "sha256", F.col("modificationTime").alias("created_at"),
        )
        ids = ids.join(store.files().select("id"), "id", "left_anti")
        ids.write.parquet(f"{store.root}/{staging}/ids")  # contents are hashed once
        ids = spark.read.schema(ids.schema).parquet(f"{store.root}/{staging}/ids")
        manifests, features = process_files(files.join(ids.select("path"), "path", "left_semi"), limits, f"{store.root}/{staging}")
        store.publish(manifests.where(F.col("format").isNotNull()), features, ids)
        store.remove(staging)

    return arriving.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
