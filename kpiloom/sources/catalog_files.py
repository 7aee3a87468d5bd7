"""Report templates and KPI catalog documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kpiloom.schemas import KPI_CATALOG, TEMPLATE, fields
from kpiloom.sources import snapshots


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """One row per template document, keyed by its own ``template_id``, not by file name."""
    return spark.read.schema(TEMPLATE).json(path, multiLine=True)


def parse_templates(documents: DataFrame, column: str) -> DataFrame:
    """The same rows from a column of JSON texts."""
    return documents.select(F.from_json(column, fields(TEMPLATE)).alias("t")).select("t.*")


def template_charts(templates: DataFrame) -> DataFrame:
    """One row per chart in document order, with the defaults of a chart."""
    return (
        templates.select("template_id", F.posexplode("charts").alias("chart_pos", "c"))
        .select(
            "template_id", "chart_pos", "c.chart_id", "c.type", "c.title", "c.kpi",
            chart_kpis(F.col("c.kpis"), F.col("c.kpi")).alias("kpis"),
            F.coalesce("c.x_axis", F.lit("date")).alias("x_axis"),
            F.coalesce("c.y_format", F.lit("percentage")).alias("y_format"),
        )
    )


def chart_kpis(kpis: Column, kpi: Column) -> Column:
    """The chart's KPI list, or its single KPI, or nothing."""
    single = F.when(F.coalesce(kpi, F.lit("")) != "", F.array(kpi)).otherwise(
        F.array().cast("array<string>"))
    return F.coalesce(kpis, single)


def parse_catalog(documents: DataFrame, column: str) -> DataFrame:
    """Catalog rows with defaults from a column of JSON texts, one KPI each."""
    rows = documents.select(F.from_json(column, fields(KPI_CATALOG)).alias("k")).select("k.*")
    return with_catalog_defaults(rows)


def read_catalog(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Catalog rows with defaults from files that are a JSON array or object each, or with ``lines`` one object a line,
    which Spark can split."""
    return with_catalog_defaults(spark.read.schema(KPI_CATALOG).json(path, multiLine=not lines))


def with_catalog_defaults(rows: DataFrame) -> DataFrame:
    empty = F.array().cast("array<string>")
    both_absent = F.col("expected_range.min").isNull() & F.col("expected_range.max").isNull()
    return (
        rows.withColumn("description", F.coalesce("description", F.lit("")))
        .withColumn("aliases", F.coalesce("aliases", empty))
        .withColumn("source_fields", F.coalesce("source_fields", empty))
        .withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
        .withColumn("expected_range", F.when(~both_absent, F.col("expected_range")))
    )


def replace_catalog(rows: DataFrame, path: str) -> None:
    """Snapshot load: the rows take the place of whatever was there, at once."""
    snapshots.publish(rows, path)


def stored_catalog(spark: SparkSession, path: str) -> DataFrame:
    return snapshots.current(spark, path)
