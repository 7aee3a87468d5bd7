"""KPI catalog and report templates over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from kpiloom.functions.frames import literal_rows
from kpiloom.operators.kpi import ColumnMapping, KpiDef
from kpiloom.schemas import NO_DENOMINATOR
from kpiloom.sources.catalog_files import parse_catalog, parse_templates

_KPIS = [
    KpiDef("gross_sales", "l_extendedprice", format="currency", domain="sales",
           display_name="Gross Sales", aliases=("sales total", "red widget")),
    KpiDef("units_sold", "l_quantity", format="integer", domain="sales", max=10,
           display_name="Units Sold", aliases=("unit count", "small bolts")),
    KpiDef("avg_unit_price", "l_extendedprice", "l_quantity", "currency", "sales", 0, 1000,
           "Average Unit Price", ("price per unit", "gear price")),
    KpiDef("tax_to_discount", "l_tax", "l_discount", "percentage", "ops", 0, 1,
           "Tax to Discount", ("tax share", "cold plates")),
    KpiDef("order_value", "o_totalprice", format="currency", domain="sales",
           display_name="Order Value", aliases=("order total",)),
    KpiDef("error_rate", "is_error", "one", "percentage", "cx", 0, 0.1, "Error Rate",
           ("errors per event", "new ring rate")),
    KpiDef("purchase_per_view", "is_purchase", "is_view", "percentage", "cx", 1, None,
           "Purchases per View", ("buy rate",)),
    KpiDef("zero_den", "l_quantity", "zero", "percentage", "ops", display_name="Zero Denominator",
           aliases=("old rod",)),
    KpiDef("missing_den", "o_totalprice", "no_denominator", "percentage", "ops",
           display_name="Missing Denominator"),
    KpiDef("missing_num", "no_such_column", format="integer", domain="ops", display_name=None,
           reviewed=False),
]
CATALOG = {k.kpi_id: k for k in _KPIS}

MAPPING = {
    "gross_sales": ColumnMapping(raw_column="l_extendedprice"),
    "units_sold": ColumnMapping(numerator_column="l_quantity"),
    "avg_unit_price": ColumnMapping("l_tax", "l_extendedprice", "l_quantity"),
    "tax_to_discount": ColumnMapping(None, "l_tax", "l_discount"),
    "order_value": ColumnMapping(raw_column="o_totalprice"),
    "error_rate": ColumnMapping(None, "is_error", "one"),
    "purchase_per_view": ColumnMapping(None, "is_purchase", "is_view"),
    "zero_den": ColumnMapping(None, "l_quantity", "zero"),
    "missing_den": ColumnMapping(raw_column="l_quantity"),
    "missing_num": ColumnMapping(raw_column="no_such_column"),
}


def catalog_documents() -> list[str]:
    documents = []
    for k in CATALOG.values():
        limits = {n: v for n, v in (("min", k.min), ("max", k.max)) if v is not None}
        documents.append(json.dumps({
            "kpi_id": k.kpi_id, "display_name": k.display_name, "numerator": k.numerator,
            "denominator": k.denominator, "format": k.format, "domain": k.domain,
            "expected_range": limits or None, "aliases": list(k.aliases),
            "source_fields": list(k.source_fields), "reviewed": k.reviewed,
        }))
    return documents


def catalog_frame(spark: SparkSession) -> DataFrame:
    rows = literal_rows(spark, [(d,) for d in catalog_documents()], ["document"])
    return parse_catalog(rows, "document")


def _sql(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else str(value)


CATALOG_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_sql(k.kpi_id)}, {_sql(k.display_name)}, {_sql(k.denominator == NO_DENOMINATOR)}, "
    f"{_sql(k.format)}, {_sql(k.min)}, {_sql(k.max)}, {_sql(str(k.min) if k.min is not None else None)}, "
    f"{_sql(str(k.max) if k.max is not None else None)})"
    for k in CATALOG.values()
) + ") AS t(kpi_id, display_name, is_total, format, low, high, low_text, high_text)"


def _chart(chart_id, kind, title, kpi=None, kpis=None, x_axis=None, y_format=None) -> dict:
    chart = {"chart_id": chart_id, "type": kind, "title": title, "kpi": kpi, "kpis": kpis,
             "x_axis": x_axis, "y_format": y_format}
    return {k: v for k, v in chart.items() if v is not None}


TEMPLATES = [
    {
        "template_id": "client_health_dashboard", "display_name": "Client Health",
        "domain": "sales", "required_kpis": ["gross_sales", "avg_unit_price"],
        "optional_kpis": ["units_sold"], "required_dimensions": ["l_shipdate", "l_returnflag"],
        "optional_dimensions": ["l_linestatus"],
        "charts": [
            _chart("price_line", "line", "Unit Price by Week", "avg_unit_price", x_axis="l_shipdate",
                   y_format="currency"),
            _chart("price_bars", "bar", "Unit Price by Flag", "avg_unit_price",
                   x_axis="l_returnflag", y_format="currency"),
        ],
    },
    {
        "template_id": "wbr_qbr", "display_name": "Business Review", "domain": "sales",
        "required_kpis": ["gross_sales", "units_sold", "tax_to_discount"],
        "optional_kpis": ["zero_den", "kpi_1"], "required_dimensions": ["l_shipdate"],
        "optional_dimensions": [],
        "charts": [
            _chart("tiles", "kpi_card", "Summary", kpis=["units_sold", "gross_sales", "zero_den"],
                   y_format="mixed"),
            _chart("tax_line", "line", "Tax to Discount", "tax_to_discount"),
        ],
    },
    {
        "template_id": "exec_scorecard", "display_name": "Scorecard", "domain": "ops",
        "required_kpis": ["units_sold"], "optional_kpis": [], "required_dimensions": ["l_shipdate"],
        "optional_dimensions": [],
        "charts": [_chart("units", "bar", "Units", kpis=["units_sold", "missing_den"],
                          x_axis="l_shipdate", y_format="integer"),
                   _chart("empty", "line", "Nothing")],
    },
    {
        "template_id": "kpi_spotlight", "display_name": "Spotlight", "domain": "any",
        "required_kpis": [], "optional_kpis": ["__any__"], "required_dimensions": ["l_shipdate"],
        "optional_dimensions": ["l_returnflag"],
        "charts": [
            _chart("one_line", "line", "{kpi_display_name} over Time", "__selected__",
                   y_format="__kpi_format__"),
            _chart("one_bar", "bar", "{kpi_display_name} by {dimension}", "__selected__",
                   x_axis="__selected_dimension__", y_format="__kpi_format__"),
        ],
    },
]


def template_frame(spark: SparkSession) -> DataFrame:
    rows = literal_rows(spark, [(json.dumps(t),) for t in TEMPLATES], ["document"])
    return parse_templates(rows, "document")


CHARTS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_sql(t['template_id'])}, {i}, {_sql(c['chart_id'])}, {_sql(c['type'])}, {_sql(c['title'])}, "
    f"{_sql(c.get('kpi'))}, {c.get('kpis', [c['kpi']] if 'kpi' in c else [])}::VARCHAR[], "
    f"{_sql(c.get('x_axis', 'date'))}, {_sql(c.get('y_format', 'percentage'))})"
    for t in TEMPLATES for i, c in enumerate(t["charts"])
) + ") AS t(template_id, chart_pos, chart_id, type, title, kpi, kpis, x_axis, y_format)"

TEMPLATE_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"({_sql(t['template_id'])}, {t['required_kpis']}::VARCHAR[], {t['optional_kpis']}::VARCHAR[], "
    f"{t['required_dimensions']}::VARCHAR[])" for t in TEMPLATES
) + ") AS t(template_id, required_kpis, optional_kpis, required_dimensions)"
