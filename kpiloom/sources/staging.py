"""Staged tables and their registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stage(df: DataFrame, root: str, upload_id: int) -> str:
    """Write one upload's rows; staging it again replaces them."""
    path = f"{root}/staging_{upload_id}"
    df.write.mode("overwrite").parquet(path)
    return path


def stage_many(df: DataFrame, path: str, key: str = "upload_id") -> None:
    """Write many uploads of one layout at once, replacing only the uploads present.

    Rebalanced by upload, so that small uploads get one file and a large one is split.
    """
    (
        df.hint("rebalance", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).parquet(path)
    )


def registry_row(profile: DataFrame, counts: DataFrame, client_id: str, upload_id: int) -> DataFrame:
    """One registry row of an upload: counts and the column profile as JSON.

    ``profile`` has one row per column of a table, so the gathered array is as long as the
    table is wide. ``counts`` is the single row of row and duplicate counts.
    """
    columns = profile.agg(
        F.count(F.lit(1)).cast("int").alias("column_count"),
        F.to_json(F.transform(
            F.sort_array(F.collect_list(F.struct(
                "position", "name", "raw_dtype", "detected_type", "suggested_role",
                "missing_count", "missing_pct", "unique_count", "sample_values"))),
            lambda c: c.dropFields("position"),
        )).alias("profile_data"),
    )
    one = columns.unionByName(counts, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns]).select(
        F.lit(client_id).alias("client_id"), F.lit(upload_id).alias("upload_id"),
        F.lit(f"staging_{upload_id}").alias("table_name"),
        "row_count", "column_count", "duplicate_row_count", "profile_data",
    )


def register(row: DataFrame, path: str, upload_id: int) -> None:
    """Write an upload's registry row into its own partition.

    Uploads ingested at the same time do not share a write folder, and one ingested again replaces
    its row.
    """
    row.drop("upload_id").write.mode("overwrite").parquet(f"{path}/upload_id={upload_id}")
