"""Uploads to profiles: admit, scan, rename, stage, profile and register."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from kpiloom.operators import keyed_profile
from kpiloom.operators.profile import duplicate_counts, profile_columns
from kpiloom.sources import delimited, keyed, staging, uploads


@dataclass(frozen=True)
class Upload:
    upload_id: int
    client_id: str
    path: str


def ingest_upload(spark: SparkSession, upload: Upload, root: str) -> None:
    """Admit, stage and register one delimited upload; running it again replaces both.

    An upload with a file of another type, or one too large, fails with the reason of the first.
    """
    files = uploads.admit(uploads.list_files(spark, upload.path), allowed=[".csv"])
    refused = files.where(~F.col("accepted")).agg(F.min_by("reason", "filename")).first()[0]
    if refused:
        raise ValueError(refused)
    scanned = delimited.with_normalised_headers(delimited.scan_delimited(spark, upload.path))
    staged = spark.read.parquet(staging.stage(scanned, root, upload.upload_id))
    row = staging.registry_row(profile_columns(staged), duplicate_counts(staged),
                               upload.client_id, upload.upload_id)
    staging.register(row, f"{root}/registry", upload.upload_id)


def ingest_uploads(spark: SparkSession, pending: DataFrame, folder: str, root: str) -> DataFrame:
    """Take in all uploads of ``pending`` (upload_id, client_id) at once and return (upload_id, error_message).

    Files lie at ``<folder>/<upload_id>/``. One scan reads the files of all uploads, whatever their headers; counts,
    samples and registry rows carry the upload as a key, so the number of jobs does not grow with the number of
    uploads. An upload fails alone: with the reason of its first refused or unreadable file, or for having none.
    Below ``root`` the tables ``staged`` (row, values as text of their columns' types), ``columns``, ``registry`` and
    ``outcomes`` hold one folder per upload; taking an upload in again replaces its folders.
    """
    asked = pending.select(F.col("upload_id").cast("bigint").alias("upload_id"), "client_id")
    listed = keyed.admitted_files(spark, folder, [".csv"]).join(asked, "upload_id", "left_semi")
    read = keyed.records(spark, folder)
    found = listed.select("path", "upload_id", F.col("reason").alias("refused")).join(
        keyed.headers(read).drop("upload_id"), "path", "left")
    files = _written(found.withColumn("error", F.coalesce("refused", "problem")), f"{root}/_files")
    failed = files.where("error IS NOT NULL").groupBy("upload_id").agg(F.min_by("error", "path").alias("error_message"))
    known = asked.join(files.select("upload_id").distinct(), "upload_id", "left_semi").select("upload_id")
    missing = asked.join(known, "upload_id", "left_anti").select(
        "upload_id", F.concat(F.lit(f"No file with content in {folder}/"), F.col("upload_id").cast("string")).alias("error_message"))
    errors = failed.unionByName(missing)
    good = files.join(failed, "upload_id", "left_anti")
    columns, places = keyed.layout(good)
    columns = _written(columns, f"{root}/_columns")
    text = _written(keyed.rows(read, places), f"{root}/_rows")
    counts = _written(keyed_profile.value_counts(text), f"{root}/_counts")
    types = _written(keyed_profile.column_types(counts), f"{root}/_types")
    staging.stage_many(keyed_profile.typed_rows(text, types), f"{root}/staged")
    typed = columns.select("upload_id", F.posexplode("columns").alias("position", "name")).join(
        types.select("upload_id", "position", "kind"), ["upload_id", "position"], "left")
    staging.stage_many(typed.withColumn("kind", F.coalesce("kind", F.lit("double"))), f"{root}/columns")
    staged = spark.read.parquet(f"{root}/staged").join(columns.select("upload_id"), "upload_id", "left_semi")
    profile = keyed_profile.profile_uploads(text, columns, counts, types)
    rows = keyed_profile.registry(profile, keyed_profile.duplicate_counts(staged), asked)
    staging.stage_many(rows, f"{root}/registry")
    outcomes = asked.select("upload_id").join(errors, "upload_id", "left")
    staging.stage_many(outcomes, f"{root}/outcomes")
    return spark.read.schema(outcomes.schema).parquet(f"{root}/outcomes").join(
        asked.select("upload_id"), "upload_id", "left_semi")


def _written(frame: DataFrame, path: str) -> DataFrame:
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def staged_upload(spark: SparkSession, root: str, upload_id: int) -> DataFrame:
    """The rows of one staged upload with its own columns and types, in file order of its rows."""
    columns = spark.read.parquet(f"{root}/columns").where(F.col("upload_id") == upload_id).orderBy("position").collect()
    kinds = {"long": "bigint", "double": "double", "boolean": "boolean", "text": "string"}
    rows = spark.read.parquet(f"{root}/staged").where(F.col("upload_id") == upload_id)
    return rows.orderBy("row").select(*[
        F.get("values", F.lit(c["position"])).cast(kinds[c["kind"]]).alias(c["name"]) for c in columns])
