"""Report assembly: tiles, chart series, documents, display text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kpiloom.functions.numbers import formatted
from kpiloom.schemas import READY_STATUSES
from kpiloom.sources.catalog_files import chart_kpis


def kpi_tiles(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Computed KPIs with display name (else the id) and format (else percentage)."""
    meta = catalog.select("kpi_id", F.col("display_name").alias("_name"),
                          F.col("format").alias("_format"))
    return (
        results.join(meta, "kpi_id", "left")
        .withColumn("display_name", F.coalesce("_name", "kpi_id"))
        .withColumn("format", F.coalesce("_format", F.lit("percentage")))
        .drop("_name", "_format")
    )


def format_tiles(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("display_value", formatted(F.col("value"), F.col("format")))


def gather_results(tiles: DataFrame, key: str = "request_id") -> DataFrame:
    """Tiles and report flags of each request as arrays in KPI order.

    Both are as long as the request's KPI list. A KPI outside the catalog has flags but no tile.
    """
    tile = F.struct("position", "kpi_id", "display_name", "value", "format", "flags")
    return tiles.groupBy(key).agg(
        F.sort_array(F.collect_list(F.when(F.col("in_catalog"), tile))).alias("_tiles"),
        F.sort_array(F.collect_list(F.struct("position", "report_flags"))).alias("_flags"),
    )


def _tile_fields(t: Column) -> Column:
    return t.dropFields("position")


def build_reports(requests: DataFrame, results: DataFrame, catalog: DataFrame,
                  templates: DataFrame, key: str = "request_id") -> DataFrame:
    """Tiles, chart series and report flags per request.

    Results are gathered once per request; a chart's series is then looked up inside the row,
    so neither charts nor series are exploded and regrouped. A KPI that was not computed leaves
    its series out, and a chart without series stays. Templates are found by their id.
    """
    charts = templates.select(F.col("template_id").alias("template_type"), "charts")
    joined = (
        requests.join(gather_results(kpi_tiles(results, catalog), key), key, "left")
        .join(charts, "template_type", "left")
    )
    tiles = F.coalesce(F.transform("_tiles", _tile_fields), F.array())
    flags = F.flatten(F.transform("_flags", lambda f: f["report_flags"]))

    def series(kpi_ids: Column) -> Column:
        return F.flatten(F.transform(
            kpi_ids, lambda k: F.filter("kpi_tiles", lambda t: t["kpi_id"] == k)))

    def chart(c: Column) -> Column:
        return F.struct(
            c["chart_id"].alias("chart_id"), c["type"].alias("type"), c["title"].alias("title"),
            F.coalesce(c["x_axis"], F.lit("date")).alias("x_axis"),
            F.coalesce(c["y_format"], F.lit("percentage")).alias("y_format"),
            series(chart_kpis(c["kpis"], c["kpi"])).alias("series"),
        )

    return (
        joined.withColumn("kpi_tiles", tiles)
        .withColumn("charts", F.coalesce(F.transform("charts", chart), F.array()))
        .withColumn("data_quality_flags", F.coalesce(flags, F.array().cast("array<string>")))
        .drop("_tiles", "_flags")
    )


def chart_series(reports: DataFrame, key: str = "request_id") -> DataFrame:
    """One row per chart and series; a chart without series has one row with nulls."""
    return (
        reports.select(key, F.posexplode("charts").alias("chart_pos", "c"))
        .select(key, "chart_pos", "c.chart_id", "c.x_axis", "c.y_format",
                F.posexplode_outer("c.series").alias("series_pos", "s"))
        .select(key, "chart_pos", "chart_id", "x_axis", "y_format", "series_pos",
                "s.kpi_id", "s.display_name", "s.value", "s.format", "s.flags")
    )


def report_documents(reports: DataFrame, key: str = "request_id") -> DataFrame:
    """One JSON document per request."""
    body = F.struct("template_type", "client_id", "period_start", "period_end", "kpi_tiles",
                    "charts", "data_quality_flags")
    return reports.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("document"))


def ready_reports(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests whose report can be shown, and the others with the reason."""
    ready = requests.where(F.col("status").isin(READY_STATUSES))
    waiting = requests.where(~F.coalesce(F.col("status").isin(READY_STATUSES), F.lit(False)))
    return ready, waiting.withColumn("message", F.concat(
        F.lit("Dashboard not ready. Current status: "), F.coalesce("status", F.lit("None")),
        F.lit(". Complete the agent pipeline first.")))


def resolve_spotlight(charts: DataFrame, kpi_id: Column, display_name: Column, format: Column,
                      dimension: Column) -> DataFrame:
    """Charts with the placeholders of a single-KPI report replaced by the selection.

    The placeholder names are fixed values.
    """
    title = F.replace(F.replace(F.col("title"), F.lit("{kpi_display_name}"), display_name),
                      F.lit("{dimension}"), dimension)

    def swap(column: str, mark: str, value: Column) -> Column:
        return F.when(F.col(column) == mark, value).otherwise(F.col(column))

    return charts.withColumns({
        "title": title,
        "kpi": swap("kpi", "__selected__", kpi_id),
        "kpis": F.transform("kpis", lambda k: F.when(k == "__selected__", kpi_id).otherwise(k)),
        "x_axis": swap("x_axis", "__selected_dimension__", dimension),
        "y_format": swap("y_format", "__kpi_format__", format),
    })


def apply_overrides(results: DataFrame, entries: DataFrame, key: str = "request_id",
                    order: str = "entry_seq") -> DataFrame:
    """KPI values as published: a reviewer's value replaces the computed one.

    ``entries`` is (key, order, overrides map), one row per approved review entry; of several that
    name the same KPI the one last in ``order`` counts.
    """
    chosen = (
        entries.select(key, order, F.explode("overrides").alias("kpi_id", "_value"))
        .groupBy(key, "kpi_id").agg(F.max_by("_value", order).alias("_override"))
    )
    return (
        results.join(chosen, [key, "kpi_id"], "left")
        .withColumn("overridden", F.col("_override").isNotNull())
        .withColumn("value", F.coalesce("_override", "value")).drop("_override")
    )
