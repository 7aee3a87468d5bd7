"""Control-table schemas and the value sets the rules check against."""

from __future__ import annotations

from pyspark.sql import types as T

# Allowed formats, domains, templates, upload types, statuses and marks.
KPI_FORMATS = ["percentage", "integer", "currency", "duration"]
KPI_DOMAINS = ["collections", "cx", "sales", "workforce", "ops"]
TEMPLATE_IDS = ["client_health_dashboard", "wbr_qbr", "exec_scorecard", "kpi_spotlight"]
UPLOAD_TYPES = [".xlsx", ".csv"]
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
READY_STATUSES = ["computed", "review", "approved"]
NO_DENOMINATOR = "_none_"
ANY_KPI = "__any__"
REVIEW_THRESHOLD = 0.7

# The five items of a report interview, in order.
INTERVIEW_STEPS = [
    "Date column", "KPI definitions", "Dimensions", "Time granularity", "Filters",
]

# Texts a delimited file may use for a missing value.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

RANGE = "STRUCT<min: DOUBLE, max: DOUBLE>"

KPI_CATALOG = (
    "kpi_id STRING, display_name STRING, description STRING, numerator STRING, "
    f"denominator STRING, format STRING, domain STRING, expected_range {RANGE}, "
    "aliases ARRAY<STRING>, source_fields ARRAY<STRING>, reviewed BOOLEAN"
)
INTAKE_SPEC = (
    "template_type STRING, client_id STRING, period_start STRING, period_end STRING, "
    "kpi_list ARRAY<STRING>, data_source STRING"
)
COLUMN_MAPPING = (
    "MAP<STRING, STRUCT<raw_column: STRING, confidence: DOUBLE, needs_review: BOOLEAN, "
    "numerator_column: STRING, denominator_column: STRING>>"
)
COMPUTED_KPIS = "MAP<STRING, STRUCT<value: DOUBLE, flags: ARRAY<STRING>>>"
CHART = (
    "STRUCT<chart_id: STRING, type: STRING, title: STRING, kpi: STRING, kpis: ARRAY<STRING>, "
    "x_axis: STRING, y_format: STRING>"
)
TEMPLATE = (
    "template_id STRING, display_name STRING, description STRING, domain STRING, "
    "required_kpis ARRAY<STRING>, optional_kpis ARRAY<STRING>, "
    "required_dimensions ARRAY<STRING>, optional_dimensions ARRAY<STRING>, "
    f"charts ARRAY<{CHART}>"
)
INTERVIEW_RESULT = (
    "date_column STRING, kpis ARRAY<STRUCT<name: STRING, formula: STRING>>, "
    "dimensions ARRAY<STRING>, granularity STRING, filters ARRAY<STRING>"
)


def fields(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
