"""The given tables, and control tables that plain SQL derives from them.

The SQL keeps to what Spark and DuckDB share, so the same text feeds a query and its check.
Nothing here is small by construction: every derived table grows with the table it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

DERIVED = {
    # The events as 150 uploads, all columns as the texts of delimited files, a twentieth of the rows repeated.
    "keyed_events": """
        SELECT user_id % 150 AS upload_id, event_id AS at_row, CAST(event_id AS STRING) AS event_id,
               SUBSTR(CAST(ts AS STRING), 1, 19) AS ts, CAST(user_id AS STRING) AS user_id, event_type,
               CASE WHEN event_type <> 'error' THEN CAST(value AS STRING) END AS value, props
        FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_id % 20 = 0)""",
    # All orders as 120 uploads by customer, a tenth of the rows repeated.
    "uploaded": """
        SELECT o_custkey % 120 AS upload_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               SUBSTR(CAST(o_orderdate AS STRING), 1, 10) AS o_day, o_orderpriority
        FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)""",
    # Report requests: one per order.
    "requests": """
        SELECT CAST(o_orderkey AS STRING) AS request_id,
               'user_' || CAST(o_custkey % 40 AS STRING) AS created_by,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'client_health_dashboard'
                    WHEN '2-HIGH' THEN 'wbr_qbr' WHEN '3-MEDIUM' THEN 'exec_scorecard'
                    WHEN '5-LOW' THEN 'kpi_spotlight' ELSE 'monthly_pack' END AS template_type,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE 'client_' || CAST(o_custkey AS STRING) END AS client_id,
               SUBSTR(CAST(o_orderdate AS STRING), 1, 7) || '-01' AS period_start,
               SUBSTR(CAST(o_orderdate AS STRING), 1, 10) AS period_end,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'approved'
                    WHEN o_orderstatus = 'F' THEN 'rejected'
                    WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'computed'
                    WHEN o_orderstatus = 'O' THEN 'review'
                    WHEN o_orderkey % 2 = 0 THEN 'awaiting_upload' ELSE 'intake' END AS status,
               o_orderdate AS created_at
        FROM orders""",
    # The KPIs each request names, in list order; ids past the catalog are unknown and a third
    # of all requests share `kpi_1`.
    "requested": """
        SELECT CAST(o_orderkey AS STRING) AS request_id, 0 AS position,
               'kpi_' || CAST(o_custkey AS STRING) AS kpi_id FROM orders
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), 1, 'kpi_' || CAST(o_orderkey + 2 AS STRING) FROM orders
        UNION ALL
        SELECT CAST(o_orderkey AS STRING), 2, 'kpi_' || CAST(LENGTH(o_orderstatus) AS STRING)
        FROM orders WHERE o_orderstatus = 'F'""",
    "request_lists": """
        SELECT CAST(o_orderkey AS STRING) AS request_id,
               'kpi_' || CAST(o_custkey AS STRING) || ',kpi_' || CAST(o_orderkey + 2 AS STRING)
               || CASE WHEN o_orderstatus = 'F' THEN ',kpi_1' ELSE '' END AS kpis
        FROM orders""",
    # A governed catalog: one KPI per part.
    "part_catalog": """
        SELECT 'kpi_' || CAST(p_partkey AS STRING) AS kpi_id, p_name || ' ' || p_type AS display_name,
               CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'about ' || p_name END AS description,
               'units_' || CAST(p_size AS STRING) AS numerator,
               CASE WHEN p_size % 3 = 0 THEN '_none_'
                    ELSE 'orders_' || CAST(p_size AS STRING) END AS denominator,
               CASE p_size % 4 WHEN 0 THEN 'percentage' WHEN 1 THEN 'integer'
                    WHEN 2 THEN 'currency' ELSE 'duration' END AS format,
               CASE p_partkey % 5 WHEN 0 THEN 'collections' WHEN 1 THEN 'cx' WHEN 2 THEN 'sales'
                    WHEN 3 THEN 'workforce' ELSE 'ops' END AS domain,
               p_partkey % 3 <> 0 AS reviewed, p_partkey, p_size, p_retailprice
        FROM part""",
    # KPI proposals: one per part, many under the same name.
    "proposals": """
        SELECT p_partkey AS seq,
               CASE WHEN p_partkey % 97 = 0 THEN '!!!' WHEN p_partkey % 41 = 0 THEN p_name || ' 2'
                    ELSE UPPER(p_name) || ' Rate ' || p_brand END AS display_name,
               CASE p_size % 5 WHEN 0 THEN 'percentage' WHEN 1 THEN 'integer' WHEN 2 THEN 'currency'
                    WHEN 3 THEN 'duration' ELSE 'ratio' END AS format,
               CASE p_partkey % 6 WHEN 0 THEN 'collections' WHEN 1 THEN 'cx' WHEN 2 THEN 'sales'
                    WHEN 3 THEN 'workforce' WHEN 4 THEN 'ops' ELSE 'finance' END AS domain,
               CASE WHEN p_size % 7 = 0 THEN '' ELSE 'units_' || CAST(p_size AS STRING) END AS numerator,
               CASE WHEN p_size % 3 = 0 THEN '_none_' WHEN p_size % 11 = 0 THEN NULL
                    ELSE 'orders_' || CAST(p_size AS STRING) END AS denominator,
               CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS low,
               CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS high,
               p_size, p_name, p_brand, p_type
        FROM part""",
    # Uploads: one per order, under its customer.
    "uploads": """
        SELECT o_orderkey AS upload_id, 'client_' || CAST(o_custkey AS STRING) AS client_id,
               o_orderkey AS dataset_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'orders.csv' WHEN 1 THEN 'Orders.2024.XLSX'
                    WHEN 2 THEN 'orders.txt' WHEN 3 THEN 'orders' WHEN 4 THEN 'week.1.csv'
                    ELSE 'orders.' END AS filename,
               (o_orderkey * 7919 + 13) % 80000000 AS size_bytes,
               CASE o_orderstatus WHEN 'F' THEN 'profiled' WHEN 'O' THEN 'pending'
                    ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'failed' ELSE 'profiling' END END AS status,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
                    THEN 'bad row ' || CAST(o_custkey AS STRING) END AS error_message
        FROM orders""",
    "parse_results": """
        SELECT o_orderkey AS upload_id,
               CASE WHEN o_custkey % 5 = 0 THEN 'no header in file ' || CAST(o_orderkey AS STRING)
                    END AS error_message
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "staging": """
        SELECT o_orderkey AS upload_id,
               CASE WHEN o_custkey % 4 = 0 THEN NULL
                    ELSE '{"rows": ' || CAST(o_custkey AS STRING) || '}' END AS profile_data
        FROM orders WHERE o_orderpriority <> '5-LOW'""",
    # File headers: the part names each order lists, in line order.
    "file_headers": """
        SELECT l_orderkey AS upload_id, MIN(l_linenumber) AS position, p_name AS header
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name""",
    "file_mappings": """
        SELECT l_orderkey AS upload_id, 'kpi_' || CAST(l_linenumber AS STRING) AS kpi_id,
               MIN(p_name) AS numerator_column,
               CASE WHEN MIN(l_suppkey) % 7 = 0 THEN NULL WHEN MIN(l_suppkey) % 2 = 0 THEN MIN(p_name)
                    ELSE 'total ' || MIN(p_type) END AS denominator_column,
               MIN(l_suppkey) % 5 = 0 AS is_total
        FROM lineitem JOIN part ON (l_partkey + l_linenumber % 2) = p_partkey
        GROUP BY l_orderkey, l_linenumber""",
    # Mapping records before and after a confirmation.
    "mapping_current": """
        SELECT CAST(o_orderkey AS STRING) AS request_id, 'kpi_' || CAST(o_custkey AS STRING) AS kpi_id,
               'col_' || o_orderpriority AS raw_column,
               CAST(o_orderkey % 100 AS STRING) AS confidence
        FROM orders WHERE o_orderstatus <> 'F'""",
    "mapping_incoming": """
        SELECT CAST(o_orderkey AS STRING) AS request_id, 'kpi_' || CAST(o_custkey AS STRING) AS kpi_id,
               'den_' || o_orderstatus AS denominator_column, o_orderkey % 4 = 0 AS clears_raw
        FROM orders WHERE o_totalprice > 200000""",
    "memory": """
        SELECT 'client_' || CAST(c_custkey AS STRING) AS client_id, 'wbr_qbr' AS template_type,
               'stored ' || c_mktsegment AS mappings, 'reviewer' AS approved_by,
               c_nationkey AS use_count FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "approvals": """
        SELECT 'client_' || CAST(o_custkey AS STRING) AS client_id,
               CASE WHEN o_orderkey % 2 = 0 THEN 'wbr_qbr' ELSE 'exec_scorecard' END AS template_type,
               o_orderkey AS seq, 'from ' || CAST(o_orderkey AS STRING) AS mappings,
               'user_' || o_orderstatus AS approved_by FROM orders""",
    # Review queue: two entries for every second order.
    "review_entries": """
        SELECT 'rev_' || CAST(o_orderkey AS STRING) AS entry_id, o_orderkey AS entry_seq,
               CAST(o_orderkey - o_orderkey % 2 AS STRING) AS request_id,
               CASE o_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved'
                    ELSE 'rejected' END AS status
        FROM orders""",
    "decisions": """
        SELECT 'rev_' || CAST(event_id % 4000 AS STRING) AS entry_id, event_id AS seq,
               CASE WHEN event_type IN ('error', 'view') THEN 'rejected' ELSE 'approved' END AS decision,
               CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS reviewer_notes,
               CASE WHEN event_type IN ('purchase', 'error') THEN value END AS override_value,
               ts AS reviewed_at
        FROM events""",
    # Interview answers as the JSON texts an extraction returns; some are cut off or incomplete.
    "answer_texts": """
        SELECT o_orderkey AS upload_id, o_orderkey + 1 AS dataset_id,
               CASE WHEN o_orderkey % 13 = 0 THEN '{"date_column": "o_ord'
               ELSE '{"date_column": ' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"o_orderdate"' END
                 || ', "kpis": ' || CASE WHEN o_orderkey % 7 = 0 THEN '[]'
                    ELSE '[{"name": "rate_' || CAST(o_custkey AS STRING) || '", "formula": "rate = o_totalprice / o_custkey"}'
                    || CASE WHEN o_orderkey % 2 = 0 THEN ', {"name": "net_value", "formula": "net_value = o_totalprice * 2"}, {"name": "orders", "formula": "o_orderkey + 1"}' ELSE '' END || ']' END
                 || ', "dimensions": ' || CASE WHEN o_orderkey % 11 = 0 THEN '[]' ELSE '["' || o_orderstatus || '_team", "o_site"]' END
                 || ', "granularity": ' || CASE WHEN o_orderkey % 17 = 0 THEN '""' ELSE '"weekly"' END
                 || ', "filters": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' WHEN o_orderkey % 3 = 1 THEN '[]' ELSE '["o_orderpriority"]' END
                 || '}' END AS answer
        FROM orders""",
    # Changes of recipe formulas, one per event.
    "formula_changes": """
        SELECT user_id AS recipe_id, event_type AS name, event_id AS seq, ts AS changed_at,
               CASE WHEN value < 40 THEN 'a / b' WHEN value < 90 THEN 'a / c' ELSE 'a' END AS formula
        FROM events""",
    # One report per supplier over its own line items.
    "supplier_requests": """
        SELECT CAST(s_suppkey AS STRING) AS request_id,
               CASE s_suppkey % 5 WHEN 0 THEN 'client_health_dashboard' WHEN 1 THEN 'wbr_qbr'
                    WHEN 2 THEN 'exec_scorecard' WHEN 3 THEN 'kpi_spotlight'
                    ELSE 'no_such_template' END AS template_type,
               'client_' || CAST(s_nationkey AS STRING) AS client_id,
               '1992-01-01' AS period_start, '2001-12-31' AS period_end,
               s_suppkey, s_nationkey
        FROM supplier""",
    "supplier_facts": """
        SELECT CAST(l_suppkey AS STRING) AS request_id, l_extendedprice, l_quantity, l_tax,
               l_discount, CAST(0 AS DOUBLE) AS zero, l_returnflag
        FROM lineitem""",
}

_SUPPLIER_LIST = [
    # position, kpi_id, numerator_column, denominator_column, suppliers that ask for it
    (0, "gross_sales", "l_extendedprice", None, "s_acctbal > 3000"),
    (1, "avg_unit_price", "l_extendedprice", "l_quantity", "s_nationkey <> 3"),
    (2, "tax_to_discount", "l_tax", "l_discount", "s_nationkey > 5"),
    (3, "zero_den", "l_quantity", "zero", "s_acctbal > 7000"),
    (4, "missing_den", "l_quantity", None, "s_nationkey < 8"),
    (5, "missing_num", "no_such_column", None, "s_acctbal < 2000"),
    (6, "not_in_catalog", "l_quantity", None, "s_nationkey > 20"),
    (7, "units_sold", "l_quantity", None, "s_acctbal < 9000"),
]


def _literal(value) -> str:
    return "CAST(NULL AS STRING)" if value is None else f"'{value}'"


DERIVED["supplier_requested"] = " UNION ALL ".join(
    f"SELECT CAST(s_suppkey AS STRING) AS request_id, {p} AS position, '{k}' AS kpi_id "
    f"FROM supplier WHERE {where}" for p, k, _, _, where in _SUPPLIER_LIST
)
DERIVED["supplier_mapping"] = " UNION ALL ".join(
    f"SELECT CAST(s_suppkey AS STRING) AS request_id, '{k}' AS kpi_id, "
    f"CAST(NULL AS STRING) AS raw_column, {_literal(n)} AS numerator_column, "
    f"{_literal(d)} AS denominator_column FROM supplier" for _, k, n, d, _ in _SUPPLIER_LIST
)


def _used(text: str, extra: dict[str, str] | None = None) -> list[str]:
    """Derived tables a text needs, each after those it needs itself."""
    known = {**DERIVED, **(extra or {})}
    found: list[str] = []

    def visit(body: str, skip: str | None = None) -> None:
        for name in known:
            if name != skip and name not in found and re.search(rf"\b{name}\b", body):
                visit(known[name], name)
                found.append(name)

    visit(text)
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given or derived table."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    derived = _used(name)
    texts = " ".join(DERIVED[d] for d in derived)
    given = [g for g in GIVEN if re.search(rf"\b{g}\b", texts)]
    parts = [f"{g} AS (SELECT * FROM parquet.`{sf_dir}/{g}.parquet`)" for g in given]
    parts += [f"{d} AS ({DERIVED[d]})" for d in derived]
    return spark.sql(f"WITH {', '.join(parts)} SELECT * FROM {name}")


def check_sql(text: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text with the derived tables it uses in front."""
    known = {**DERIVED, **(extra or {})}
    parts = [f"{d} AS ({known[d]})" for d in _used(text, extra)]
    return f"WITH {', '.join(parts)} {text}" if parts else text
