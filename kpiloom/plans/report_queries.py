"""Tiles, chart series, templates, documents, overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.operators import catalog, kpi, report
from kpiloom.plans.fixtures import (
    CATALOG, CATALOG_SQL, CHARTS_SQL, MAPPING, TEMPLATE_SQL, catalog_frame, template_frame,
)
from kpiloom.plans.kpi_queries import (
    ITEM_KPIS, SUPPLIER_KPIS, line_items, range_sql, sum_sql, supplier_results, text_of,
)
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table
from kpiloom.session import scratch_path
from kpiloom.sources.catalog_files import read_templates, template_charts
from kpiloom.sources.sinks import write_documents

CHARTS = {"charts": CHARTS_SQL}
REPORTS = {
    **SUPPLIER_KPIS, **CHARTS,
    "tiles": """
        SELECT k.request_id, k.position, k.kpi_id, COALESCE(c.display_name, k.kpi_id) AS display_name,
               k.value, COALESCE(c.format, 'percentage') AS format, k.flags
        FROM supplier_kpis k LEFT JOIN known_kpis c ON k.kpi_id = c.kpi_id WHERE k.in_catalog""",
    "series": """
        SELECT r.request_id, c.chart_pos, c.chart_id, c.x_axis, c.y_format, i - 1 AS asked_pos,
               t.kpi_id, t.display_name, t.value, t.format, t.flags
        FROM supplier_requests r JOIN charts c ON r.template_type = c.template_id,
             LATERAL (SELECT unnest(c.kpis) AS asked, generate_subscripts(c.kpis, 1) AS i) a
        JOIN tiles t ON t.request_id = r.request_id AND t.kpi_id = a.asked""",
}


@query("kpi_report_tiles", f"""
    SELECT 0 AS position, 'gross_sales' AS kpi_id, 'Gross Sales' AS display_name, ROUND({sum_sql('l_extendedprice')}, 4) AS value, 'currency' AS format, '' AS flags FROM lineitem
    UNION ALL SELECT 1, 'units_sold', 'Units Sold', ROUND({sum_sql('l_quantity')}, 4), 'integer', '' FROM lineitem
    UNION ALL SELECT 2, 'avg_unit_price', 'Average Unit Price', ROUND(v, 4), 'currency', {range_sql('v', '0', '1000')}
    FROM (SELECT {sum_sql('l_extendedprice')} / {sum_sql('l_quantity')} AS v FROM lineitem)
    UNION ALL SELECT 3, 'tax_to_discount', 'Tax to Discount', ROUND(v, 4), 'percentage', {range_sql('v', '0', '1')}
    FROM (SELECT {sum_sql('l_tax')} / {sum_sql('l_discount')} AS v FROM lineitem)
    UNION ALL SELECT 4, 'zero_den', 'Zero Denominator', NULL, 'percentage', 'denominator is zero' FROM (SELECT COUNT(*) FROM lineitem)""")
def kpi_report_tiles(spark, sf_dir):
    results = kpi.values_only(kpi.compute_kpis(line_items(spark, sf_dir), ITEM_KPIS, CATALOG, MAPPING))
    tiles = report.kpi_tiles(results, catalog_frame(spark))
    return tiles.select("position", "kpi_id", "display_name", "value", "format", text_of("flags"))


@query("kpi_tiles", """
    SELECT request_id, position, kpi_id, display_name, value, format, array_to_string(flags, ' | ') AS flags
    FROM tiles""", REPORTS)
def kpi_tiles(spark, sf_dir):
    tiles = report.kpi_tiles(kpi.values_only(supplier_results(spark, sf_dir)), catalog_frame(spark))
    return tiles.select("request_id", "position", "kpi_id", "display_name", "value", "format",
                        text_of("flags"))


@query("formatted_tiles", """
    SELECT request_id, kpi_id, CASE WHEN value IS NULL THEN NULL
        WHEN format = 'percentage' THEN format('{:,.2f}', value * 100) || '%'
        WHEN format = 'integer' THEN format('{:,.0f}', ROUND(value, 0))
        WHEN format = 'currency' THEN '$' || format('{:,.2f}', value) END AS display_value
    FROM tiles""", REPORTS)
def formatted_tiles(spark, sf_dir):
    tiles = report.kpi_tiles(kpi.values_only(supplier_results(spark, sf_dir)), catalog_frame(spark))
    return report.format_tiles(tiles).select("request_id", "kpi_id", "display_value")


def supplier_reports(spark, sf_dir):
    return report.build_reports(
        table(spark, sf_dir, "supplier_requests"), supplier_results(spark, sf_dir),
        catalog_frame(spark), template_frame(spark))


@query("chart_series", """
    SELECT request_id, chart_pos, chart_id, x_axis, y_format,
           CAST(ROW_NUMBER() OVER (PARTITION BY request_id, chart_pos ORDER BY asked_pos) - 1 AS INTEGER) AS series_pos,
           kpi_id, display_name, value, format, array_to_string(flags, ' | ') AS flags
    FROM series
    UNION ALL
    SELECT r.request_id, c.chart_pos, c.chart_id, c.x_axis, c.y_format, NULL, NULL, NULL, NULL, NULL, NULL
    FROM supplier_requests r JOIN charts c ON r.template_type = c.template_id
    WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.request_id = r.request_id AND s.chart_pos = c.chart_pos)
    """, REPORTS)
def chart_series(spark, sf_dir):
    return report.chart_series(supplier_reports(spark, sf_dir)).withColumn(
        "flags", F.array_join("flags", " | "))


@query("report_document")
def report_document(spark, sf_dir):
    return report.report_documents(supplier_reports(spark, sf_dir))


@query("report_document_parts", """
    SELECT r.request_id, r.template_type, r.client_id, COUNT(t.kpi_id) AS tile_count,
           ROUND(COALESCE(SUM(t.value), 0), 2) AS tile_sum, MIN(t.display_name) AS first_name,
           (SELECT COUNT(*) FROM charts c WHERE c.template_id = r.template_type) AS chart_count
    FROM supplier_requests r LEFT JOIN tiles t ON r.request_id = t.request_id
    GROUP BY r.request_id, r.template_type, r.client_id""", REPORTS)
def report_document_parts(spark, sf_dir):
    """The JSON documents written to files and read back; a document does not name its request, so a line does."""
    path = scratch_path(spark, "documents")
    lines = report_document(spark, sf_dir).select(F.to_json(F.struct("request_id", "document")).alias("document"))
    write_documents(lines, path)
    parsed = spark.read.schema("request_id STRING, document STRING").json(path).select("request_id", F.from_json("document", (
        "template_type STRING, client_id STRING, kpi_tiles ARRAY<STRUCT<kpi_id: STRING, "
        "display_name: STRING, value: DOUBLE>>, charts ARRAY<STRUCT<chart_id: STRING>>")).alias("d"))
    total = F.aggregate("d.kpi_tiles", F.lit(0.0), lambda a, t: a + F.coalesce(t["value"], F.lit(0.0)))
    return parsed.select(
        "request_id", "d.template_type", "d.client_id",
        F.size("d.kpi_tiles").cast("bigint").alias("tile_count"), F.round(total, 2).alias("tile_sum"),
        F.array_min("d.kpi_tiles.display_name").alias("first_name"),
        F.size("d.charts").cast("bigint").alias("chart_count"))


@query("template_charts", """
    SELECT r.request_id, c.chart_pos, c.chart_id, c.type, c.title, array_to_string(c.kpis, ',') AS kpis,
           c.x_axis, c.y_format
    FROM requests r JOIN charts c ON r.template_type = c.template_id""", CHARTS)
def template_charts_of_requests(spark, sf_dir):
    """The charts of every request, from template documents in a file each."""
    path = scratch_path(spark, "templates")
    documents = template_frame(spark).select("template_id", F.to_json(F.struct("*")).alias("document"))
    documents.repartition("template_id").write.partitionBy("template_id").text(path)
    charts = template_charts(read_templates(spark, f"{path}/*")).withColumnRenamed("template_id", "template_type")
    return (
        table(spark, sf_dir, "requests").select("request_id", "template_type")
        .join(charts, "template_type")
        .select("request_id", "chart_pos", "chart_id", "type", "title",
                F.array_join("kpis", ",").alias("kpis"), "x_axis", "y_format")
    )


@query("spotlight_charts", """
    SELECT q.request_id, c.chart_pos,
           replace(replace(c.title, '{kpi_display_name}', p.display_name), '{dimension}', q.dim) AS title,
           CASE WHEN c.kpi = '__selected__' THEN p.kpi_id ELSE c.kpi END AS kpi,
           CASE WHEN c.x_axis = '__selected_dimension__' THEN q.dim ELSE c.x_axis END AS x_axis,
           CASE WHEN c.y_format = '__kpi_format__' THEN p.format ELSE c.y_format END AS y_format
    FROM (SELECT request_id, template_type, CASE WHEN status = 'approved' THEN 'site' ELSE 'agent_id' END AS dim
          FROM requests) q
    JOIN requested s ON s.request_id = q.request_id AND s.position = 0
    JOIN part_catalog p ON p.kpi_id = s.kpi_id
    JOIN charts c ON c.template_id = q.template_type""", CHARTS)
def spotlight_charts(spark, sf_dir):
    """Charts of every request; only those of a spotlight hold placeholders."""
    chosen = table(spark, sf_dir, "requests").select(
        "request_id", F.col("template_type").alias("template_id"),
        F.when(F.col("status") == "approved", "site").otherwise("agent_id").alias("dimension"),
    ).join(table(spark, sf_dir, "requested").where("position = 0"), "request_id")
    meta = table(spark, sf_dir, "part_catalog").select("kpi_id", "display_name", "format")
    joined = chosen.join(meta, "kpi_id").join(template_charts(template_frame(spark)), "template_id")
    resolved = report.resolve_spotlight(
        joined, F.col("kpi_id"), F.col("display_name"), F.col("format"), F.col("dimension"))
    return resolved.select("request_id", "chart_pos", "title", "kpi", "x_axis", "y_format")


@query("template_kpi_menu", """
    SELECT m.template_id, m.kind, m.kpi_id, p.display_name, p.format, p.kpi_id IS NOT NULL AS in_catalog
    FROM (SELECT template_id, 'required' AS kind, unnest(required_kpis) AS kpi_id FROM templates
          UNION ALL SELECT template_id, 'optional', unnest(optional_kpis) FROM templates) m
    LEFT JOIN part_catalog p ON p.kpi_id = m.kpi_id WHERE m.kpi_id <> '__any__'
    UNION ALL
    SELECT t.template_id, 'optional', p.kpi_id, p.display_name, p.format, TRUE
    FROM templates t, part_catalog p WHERE list_contains(t.optional_kpis, '__any__')""",
    {"templates": TEMPLATE_SQL})
def template_kpi_menu(spark, sf_dir):
    return catalog.template_kpi_menu(template_frame(spark), table(spark, sf_dir, "part_catalog"))


@query("template_coverage", """
    SELECT request_id, template_type, array_to_string(mk, ',') AS missing_kpis,
           array_to_string(md, ',') AS missing_dimensions, len(mk) = 0 AND len(md) = 0 AS covered
    FROM (SELECT r.request_id, r.template_type,
                 list_filter(t.required_kpis, lambda k: NOT list_contains(string_split(a.kpis, ','), k)) AS mk,
                 list_filter(t.required_dimensions, lambda d: NOT list_contains(string_split(a.headers, ','), d)) AS md
          FROM requests r LEFT JOIN templates t ON r.template_type = t.template_id
          JOIN (SELECT CAST(o_orderkey AS STRING) AS request_id,
                       CASE WHEN o_custkey % 2 = 0 THEN 'gross_sales,avg_unit_price' ELSE 'units_sold' END AS kpis,
                       CASE WHEN o_custkey % 3 = 0 THEN 'l_shipdate' ELSE 'l_shipdate,l_returnflag' END AS headers
                FROM orders) a ON a.request_id = r.request_id)""", {"templates": TEMPLATE_SQL})
def template_coverage(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("request_id"),
        F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("gross_sales"), F.lit("avg_unit_price")))
        .otherwise(F.array(F.lit("units_sold"))).alias("kpi_list"),
        F.when(F.col("o_custkey") % 3 == 0, F.array(F.lit("l_shipdate")))
        .otherwise(F.array(F.lit("l_shipdate"), F.lit("l_returnflag"))).alias("headers"),
    )
    requests = table(spark, sf_dir, "requests").select("request_id", "template_type")
    covered = catalog.template_coverage(requests.join(asked, "request_id"), template_frame(spark))
    return covered.select(
        "request_id", "template_type", F.array_join("missing_kpis", ",").alias("missing_kpis"),
        F.array_join("missing_dimensions", ",").alias("missing_dimensions"), "covered")


@query("ready_reports", """
    SELECT request_id, template_type, client_id, status, CAST(NULL AS VARCHAR) AS message FROM requests
    WHERE status IN ('computed', 'review', 'approved')
    UNION ALL
    SELECT request_id, template_type, client_id, status, 'Dashboard not ready. Current status: ' || status
           || '. Complete the agent pipeline first.' FROM requests
    WHERE status NOT IN ('computed', 'review', 'approved')""")
def ready_reports(spark, sf_dir):
    ready, waiting = report.ready_reports(table(spark, sf_dir, "requests"))
    columns = ["request_id", "template_type", "client_id", "status", "message"]
    return ready.withColumn("message", F.lit(None).cast("string")).select(columns).unionByName(
        waiting.select(columns))


@query("overrides_applied", """
    SELECT k.request_id, k.kpi_id, COALESCE(o.v, k.value) AS value, o.v IS NOT NULL AS overridden
    FROM supplier_kpis k
    LEFT JOIN (SELECT CAST(s_suppkey AS STRING) AS request_id, 'gross_sales' AS kpi_id,
                      CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v
               FROM supplier WHERE s_acctbal > 5000
               UNION ALL SELECT CAST(s_suppkey AS STRING), 'units_sold', CAST(s_nationkey AS DOUBLE)
               FROM supplier WHERE s_acctbal > 5000) o
      ON o.request_id = k.request_id AND o.kpi_id = k.kpi_id
    WHERE k.in_catalog""", SUPPLIER_KPIS)
def overrides_applied(spark, sf_dir):
    """Approved entries of every supplier's report; every second nation's reports have a later one."""
    approved = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").withColumn(
        "request_id", F.col("s_suppkey").cast("string"))
    first = approved.select("request_id", F.lit(1).alias("entry_seq"), F.create_map(
        F.lit("gross_sales"), F.col("s_acctbal"), F.lit("units_sold"), F.col("s_nationkey").cast("double")
    ).alias("overrides"))
    later = approved.where("s_nationkey % 2 = 0").select("request_id", F.lit(2).alias("entry_seq"), F.create_map(
        F.lit("gross_sales"), F.col("s_acctbal") + 1).alias("overrides"))
    results = kpi.values_only(supplier_results(spark, sf_dir))
    return report.apply_overrides(results, first.unionByName(later)).select(
        "request_id", "kpi_id", "value", "overridden")
