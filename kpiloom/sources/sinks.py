"""Append log and report documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def log_rows(steps: DataFrame, step: str, input: Column, output: Column,
             latency_ms: Column | None = None) -> DataFrame:
    """Step-log rows: structured input and output as JSON, texts as they are."""

    def as_text(name: str, value: Column) -> Column:
        kind = steps.select(value.alias(name)).schema[name].dataType.typeName()
        return value if kind == "string" else F.to_json(value)

    return steps.select(
        "request_id", F.lit(step).alias("step"),
        as_text("input", input).alias("input"), as_text("output", output).alias("output"),
        (F.lit(0) if latency_ms is None else latency_ms).cast("int").alias("latency_ms"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per line."""
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)
