"""Upload admission, tenant-keyed layout and upload outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kpiloom.functions.text import extension, stem
from kpiloom.schemas import MAX_UPLOAD_BYTES, UPLOAD_TYPES


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and size of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size_bytes"),
    )


def admit(files: DataFrame, allowed: list[str] = UPLOAD_TYPES,
          max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """Mark each (filename, size_bytes) as accepted or rejected with the first reason.

    ``max_bytes=None`` is the report flow, which checks the type only.
    """
    ext = extension(F.col("filename"))
    names = ", ".join(allowed[:-1]) + (" or " if len(allowed) > 1 else "") + allowed[-1]
    reason = F.when(
        ~ext.isin(allowed),
        F.concat(F.lit("Unsupported file type '"), ext, F.lit(f"'. Upload {names}.")),
    )
    if max_bytes is not None:
        reason = reason.when(
            F.col("size_bytes") > max_bytes,
            F.lit(f"File exceeds {max_bytes // (1024 * 1024)}MB limit."),
        )
    return (
        files.withColumn("extension", ext)
        .withColumn("dataset_name", stem(F.col("filename")))
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
    )


def storage_key(client_id, dataset_id, filename):
    """``client/dataset/file``; every upload has its own dataset id."""
    return F.concat_ws("/", client_id, dataset_id.cast("string"), filename)


def write_tenant_layout(df: DataFrame, path: str,
                        keys: tuple[str, ...] = ("client_id", "dataset_id"),
                        max_records_per_file: int = 5_000_000) -> None:
    """Partitioned table per tenant and dataset.

    Rows are rebalanced by tenant: small tenants share a task and get one file, and a tenant with
    a third of all rows is split over as many tasks as its size asks for. The record limit keeps
    single files readable in parallel.
    """
    (
        df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys)
        .option("maxRecordsPerFile", max_records_per_file).parquet(path)
    )


def of_tenant(df: DataFrame, client_id: str) -> DataFrame:
    """Rows of one client; on the tenant layout this prunes partitions."""
    return df.where(F.col("client_id") == client_id)


def upload_outcomes(uploads: DataFrame, results: DataFrame) -> DataFrame:
    """Status of pending uploads after a parse run.

    ``results`` holds one row per upload that ran, with ``error_message`` null on success. An
    upload without a result is still profiling; other uploads keep their status.
    """
    done = results.select("upload_id", F.lit(True).alias("_ran"),
                          F.col("error_message").alias("_error"))
    pending = F.col("status").isin("pending", "profiling")
    return (
        uploads.join(done, "upload_id", "left")
        .withColumn(
            "new_status",
            F.when(~pending, F.col("status"))
            .when(F.col("_ran").isNull(), "profiling")
            .when(F.col("_error").isNotNull(), "failed")
            .otherwise("profiled"),
        )
        .withColumn("error_message",
                    F.when(pending, F.col("_error")).otherwise(F.col("error_message")))
        .withColumn("status", F.col("new_status"))
        .drop("_ran", "_error", "new_status")
    )
