"""KPI totals, ratios, flags, trends, recipe formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kpiloom.operators import kpi, recipe
from kpiloom.plans.fixtures import CATALOG, CATALOG_SQL, MAPPING, catalog_frame
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table

ITEM_KPIS = ["gross_sales", "units_sold", "avg_unit_price", "tax_to_discount", "zero_den"]
EVENT_KPIS = ["error_rate", "purchase_per_view"]


def text_of(flags: str) -> Column:
    return F.array_join(flags, " | ").alias(flags)


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("zero", F.lit(0.0))


def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mark(kind: str) -> Column:
        return (F.col("event_type") == kind).cast("int")

    return table(spark, sf_dir, "events").withColumns({
        "is_error": mark("error"), "is_purchase": mark("purchase"), "is_view": mark("view"),
        "one": F.lit(1),
    })


def sum_sql(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(38,12))) AS DOUBLE)"


def cents_sql(column: str) -> str:
    """Exact sum of a column of two decimals; casting a double to twelve adds digits that it does not have."""
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


def rounded_sql(value: str) -> str:
    """Four places by the decimal text: ROUND of a double multiplies first and takes 27.657249999999998 for a tie."""
    return f"CAST(ROUND(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38,18)), 4) AS DOUBLE)"


def range_sql(value: str, low: str | None, high: str | None, shown: str | None = None) -> str:
    """DuckDB text of the range flags of a value, joined like the query joins them.

    ``shown`` is what the text prints: the value, or the value rounded beforehand where ties must go away from zero.
    """
    parts, shown = [], shown or value
    if low is not None:
        parts.append(f"CASE WHEN {value} < {low} THEN 'value ' || printf('%.4f', {shown}) || ' below expected min {low}' END")
    if high is not None:
        parts.append(f"CASE WHEN {value} > {high} THEN 'value ' || printf('%.4f', {shown}) || ' above expected max {high}' END")
    return f"concat_ws(' | ', {', '.join(parts)})" if parts else "''"


@query("kpi_totals", f"""
    SELECT 'gross_sales' AS kpi_id, ROUND({sum_sql('l_extendedprice')}, 4) AS value, '' AS flags FROM lineitem
    UNION ALL SELECT 'units_sold', ROUND({sum_sql('l_quantity')}, 4), '' FROM lineitem
    UNION ALL SELECT 'order_value', ROUND({sum_sql('o_totalprice')}, 4), '' FROM orders""")
def kpi_totals(spark, sf_dir):
    items = kpi.compute_kpis(line_items(spark, sf_dir), ["gross_sales", "units_sold"], CATALOG, MAPPING)
    orders = kpi.compute_kpis(table(spark, sf_dir, "orders"), ["order_value"], CATALOG, MAPPING)
    return items.unionByName(orders).select("kpi_id", "value", text_of("flags"))


@query("kpi_totals_validated", f"""
    SELECT 'units_sold' AS kpi_id, ROUND(v, 4) AS value, {range_sql('v', None, '10')} AS flags
    FROM (SELECT {sum_sql('l_quantity')} AS v FROM lineitem)""")
def kpi_totals_validated(spark, sf_dir):
    return kpi.compute_kpis(
        line_items(spark, sf_dir), ["units_sold"], CATALOG, MAPPING, validate_totals=True,
    ).select("kpi_id", "value", text_of("flags"))


@query("kpi_scaled_values", """
    SELECT 'tiny_ratio' AS kpi_id, ROUND(fsum(l_extendedprice * 1e-9) / fsum(l_quantity * 1e-9), 4) AS value, '' AS flags FROM lineitem
    UNION ALL SELECT 'tiny_total', ROUND(fsum(l_quantity * 1e-9), 4), '' FROM lineitem
    UNION ALL SELECT 'huge_ratio', ROUND(fsum(l_extendedprice * 1e9) / fsum(l_quantity * 1e-9) / 1e18, 4), '' FROM lineitem""")
def kpi_scaled_values(spark, sf_dir):
    """Values far below a millionth and far above a trillion, as both sides of ratios."""
    items = table(spark, sf_dir, "lineitem").withColumns({
        "tiny": F.col("l_extendedprice") * 1e-9, "tiny_quantity": F.col("l_quantity") * 1e-9,
        "huge": F.col("l_extendedprice") * 1e9, "tiniest": F.col("l_quantity") * 1e-9})
    catalog = {
        "tiny_ratio": kpi.KpiDef("tiny_ratio", "tiny", "tiny_quantity"),
        "tiny_total": kpi.KpiDef("tiny_total", "tiny_quantity", "_none_"),
        "huge_ratio": kpi.KpiDef("huge_ratio", "huge", "tiniest")}
    mapping = {
        "tiny_ratio": kpi.ColumnMapping(None, "tiny", "tiny_quantity"),
        "tiny_total": kpi.ColumnMapping(raw_column="tiny_quantity"),
        "huge_ratio": kpi.ColumnMapping(None, "huge", "tiniest")}
    results = kpi.compute_kpis(items, list(catalog), catalog, mapping)
    scaled = F.when(F.col("kpi_id") == "huge_ratio", F.round(F.col("value") / 1e18, 4)).otherwise(F.col("value"))
    return results.select("kpi_id", scaled.alias("value"), text_of("flags"))


@query("kpi_ratios", f"""
    SELECT 'avg_unit_price' AS kpi_id, ROUND(v, 4) AS value, {range_sql('v', '0', '1000')} AS flags
    FROM (SELECT {sum_sql('l_extendedprice')} / {sum_sql('l_quantity')} AS v FROM lineitem)
    UNION ALL SELECT 'tax_to_discount', ROUND(v, 4), {range_sql('v', '0', '1')}
    FROM (SELECT {sum_sql('l_tax')} / {sum_sql('l_discount')} AS v FROM lineitem)
    UNION ALL SELECT 'zero_den', NULL, 'denominator is zero' FROM (SELECT COUNT(*) FROM lineitem)
    UNION ALL SELECT 'error_rate', ROUND(v, 4), {range_sql('v', '0', '0.1')}
    FROM (SELECT COUNT(*) FILTER (event_type = 'error') / COUNT(*) AS v FROM events)
    UNION ALL SELECT 'purchase_per_view', ROUND(v, 4), {range_sql('v', '1', None)}
    FROM (SELECT COUNT(*) FILTER (event_type = 'purchase') / COUNT(*) FILTER (event_type = 'view') AS v FROM events)""")
def kpi_ratios(spark, sf_dir):
    items = kpi.compute_kpis(
        line_items(spark, sf_dir), ["avg_unit_price", "tax_to_discount", "zero_den"], CATALOG, MAPPING)
    events = kpi.compute_kpis(marked_events(spark, sf_dir), EVENT_KPIS, CATALOG, MAPPING)
    return items.unionByName(events).select("kpi_id", "value", text_of("flags"))


@query("kpi_flags", f"""
    SELECT concat_ws(' | ',
        (SELECT 'avg_unit_price: ' || NULLIF({range_sql('v', '0', '1000')}, '')
         FROM (SELECT {sum_sql('l_extendedprice')} / {sum_sql('l_quantity')} AS v FROM lineitem)),
        'zero_den: denominator sums to zero — check column ''zero''',
        'missing_den: denominator column ''None'' not found',
        'missing_num: column ''no_such_column'' not found in file',
        'not_in_catalog: not found in catalog') AS data_quality_flags,
        CAST(4 + (SELECT COUNT(*) FROM (SELECT {sum_sql('l_extendedprice')} / {sum_sql('l_quantity')} AS v
                                        FROM lineitem) WHERE v < 0 OR v > 1000) AS INTEGER) AS flag_count""")
def kpi_flags(spark, sf_dir):
    asked = [*ITEM_KPIS, "missing_den", "missing_num", "not_in_catalog"]
    results = kpi.compute_kpis(line_items(spark, sf_dir), asked, CATALOG, MAPPING)
    return kpi.report_flags(results).select(text_of("data_quality_flags"), "flag_count")


SUPPLIER_KPIS = {
    "known_kpis": CATALOG_SQL,
    "supplier_values": f"""
        SELECT r.request_id, r.position, r.kpi_id, c.kpi_id IS NOT NULL AS in_catalog,
               m.numerator_column AS n, m.denominator_column AS d, c.is_total, c.low, c.high,
               c.low_text, c.high_text,
               CASE WHEN r.kpi_id IN ('gross_sales', 'avg_unit_price') THEN s.price
                    WHEN r.kpi_id = 'tax_to_discount' THEN s.tax ELSE s.quantity END AS top,
               CASE WHEN r.kpi_id = 'avg_unit_price' THEN s.quantity
                    WHEN r.kpi_id = 'tax_to_discount' THEN s.discount ELSE 0 END AS bottom
        FROM supplier_requested r
        LEFT JOIN known_kpis c ON r.kpi_id = c.kpi_id
        LEFT JOIN supplier_mapping m ON r.request_id = m.request_id AND r.kpi_id = m.kpi_id
        LEFT JOIN (SELECT request_id, {sum_sql('l_extendedprice')} AS price, {sum_sql('l_quantity')} AS quantity,
                          {sum_sql('l_tax')} AS tax, {sum_sql('l_discount')} AS discount
                   FROM supplier_facts GROUP BY request_id) s ON r.request_id = s.request_id""",
    "supplier_checked": """
        SELECT *, CASE WHEN NOT in_catalog OR kpi_id = 'missing_num' OR kpi_id = 'missing_den' THEN NULL
                       WHEN is_total THEN COALESCE(top, 0)
                       WHEN COALESCE(bottom, 0) = 0 THEN NULL ELSE top / bottom END AS v
        FROM supplier_values""",
    "supplier_kpis": """
        SELECT request_id, position, kpi_id, in_catalog, ROUND(v, 4) AS value,
               list_filter([CASE WHEN kpi_id = 'missing_num' THEN 'column ''no_such_column'' missing'
                    WHEN kpi_id = 'missing_den' THEN 'denominator column ''None'' missing'
                    WHEN in_catalog AND NOT is_total AND COALESCE(bottom, 0) = 0 THEN 'denominator is zero' END,
                    CASE WHEN NOT is_total AND v < low THEN 'value ' || printf('%.4f', v) || ' below expected min ' || low_text END,
                    CASE WHEN NOT is_total AND v > high THEN 'value ' || printf('%.4f', v) || ' above expected max ' || high_text END],
                    lambda x: x IS NOT NULL) AS flags,
               list_filter([CASE WHEN NOT in_catalog THEN 'not found in catalog'
                    WHEN kpi_id = 'missing_num' THEN 'column ''no_such_column'' not found in file'
                    WHEN kpi_id = 'missing_den' THEN 'denominator column ''None'' not found'
                    WHEN NOT is_total AND COALESCE(bottom, 0) = 0 THEN 'denominator sums to zero — check column ''' || d || '''' END,
                    CASE WHEN NOT is_total AND v < low THEN 'value ' || printf('%.4f', v) || ' below expected min ' || low_text END,
                    CASE WHEN NOT is_total AND v > high THEN 'value ' || printf('%.4f', v) || ' above expected max ' || high_text END],
                    lambda x: x IS NOT NULL) AS report_texts
        FROM supplier_checked""",
}


def supplier_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.compute_requests(
        table(spark, sf_dir, "supplier_facts"), table(spark, sf_dir, "supplier_requested"),
        catalog_frame(spark), table(spark, sf_dir, "supplier_mapping"))


@query("kpi_requests", """
    SELECT request_id, position, kpi_id, value, array_to_string(flags, ' | ') AS flags
    FROM supplier_kpis WHERE in_catalog""", SUPPLIER_KPIS)
def kpi_requests(spark, sf_dir):
    results = kpi.values_only(supplier_results(spark, sf_dir))
    return results.select("request_id", "position", "kpi_id", "value", text_of("flags"))


@query("kpi_requests_own_files", f"""
    WITH f AS (SELECT l_orderkey, {sum_sql('l_extendedprice')} AS price, {sum_sql('l_tax')} AS tax, {sum_sql('l_discount')} AS discount
               FROM lineitem JOIN orders ON o_orderkey = l_orderkey
               WHERE CAST(l_shipdate AS DATE) >= CAST(o_orderdate AS DATE) + 30 GROUP BY l_orderkey),
    r AS (SELECT CAST(o_orderkey AS STRING) AS request_id, o_orderkey % 3 = 0 AS lacks, COALESCE(price, 0) AS price,
                 COALESCE(tax, 0) AS tax, COALESCE(discount, 0) AS discount FROM orders LEFT JOIN f ON l_orderkey = o_orderkey)
    SELECT request_id, 'gross_sales' AS kpi_id, ROUND(price, 4) AS value, '' AS flags FROM r
    UNION ALL SELECT request_id, 'tax_to_discount', CASE WHEN NOT lacks AND discount <> 0 THEN ROUND(tax / discount, 4) END,
        CASE WHEN lacks THEN 'denominator column ''l_discount'' missing' WHEN discount = 0 THEN 'denominator is zero'
             WHEN tax / discount > 1 THEN 'value above expected max 1' ELSE '' END FROM r""")
def kpi_requests_own_files(spark, sf_dir):
    """One request per order, with a period and a file of its own; every third file lacks the discounts."""
    orders = table(spark, sf_dir, "orders").withColumn("request_id", F.col("o_orderkey").cast("string"))
    lacks = F.col("o_orderkey") % 3 == 0
    discount = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_discount"))
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("request_id"), "l_shipdate", "l_extendedprice", "l_tax",
        discount.alias("l_discount"))
    kpis = ["gross_sales", "tax_to_discount"]
    requested = orders.select("request_id", F.posexplode(F.array(*map(F.lit, kpis))).alias("position", "kpi_id"))
    nothing = F.lit(None).cast("string")
    mapped = requested.select(
        "request_id", "kpi_id", F.when(F.col("position") == 0, "l_extendedprice").alias("raw_column"),
        F.when(F.col("position") == 1, "l_tax").alias("numerator_column"),
        F.when(F.col("position") == 1, "l_discount").otherwise(nothing).alias("denominator_column"))
    files = orders.select("request_id", F.explode(F.array_compact(F.array(
        F.lit("l_extendedprice"), F.lit("l_tax"), F.when(~lacks, "l_discount")))).alias("header"))
    periods = orders.select("request_id", F.date_add(F.to_date("o_orderdate"), 30).alias("period_start"),
                            F.lit(None).cast("date").alias("period_end"))
    results = kpi.compute_requests(
        facts, requested, catalog_frame(spark), mapped, file_headers=files, periods=periods, date_column="l_shipdate")
    return kpi.values_only(results).select(
        "request_id", "kpi_id", "value",
        F.regexp_replace(F.array_join("flags", " | "), "^value [0-9.]+", "value").alias("flags"))


@query("kpi_overlapping_periods", f"""
    SELECT CAST(r.o_orderkey AS STRING) AS request_id, 'gross_sales' AS kpi_id, ROUND({sum_sql('f.o_totalprice')}, 4) AS value
    FROM orders r JOIN orders f ON f.o_custkey = r.o_custkey AND CAST(f.o_orderdate AS DATE) <= CAST(r.o_orderdate AS DATE)
         AND CAST(f.o_orderdate AS DATE) >= CAST(r.o_orderdate AS DATE) - 400
    GROUP BY r.o_orderkey""")
def kpi_overlapping_periods(spark, sf_dir):
    """For every order the sales to its customer in the 400 days up to it: periods overlap, and facts are keyed by customer."""
    orders = table(spark, sf_dir, "orders").withColumn("request_id", F.col("o_orderkey").cast("string"))
    requested = orders.select("request_id", F.lit(0).alias("position"), F.lit("gross_sales").alias("kpi_id"))
    nothing = F.lit(None).cast("string")
    mapped = requested.select("request_id", "kpi_id", F.lit("o_totalprice").alias("raw_column"),
                              nothing.alias("numerator_column"), nothing.alias("denominator_column"))
    day = F.to_date("o_orderdate")
    periods = orders.select("request_id", "o_custkey", F.date_sub(day, 400).alias("period_start"), day.alias("period_end"))
    results = kpi.compute_requests(
        table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice"), requested, catalog_frame(spark), mapped,
        periods=periods, date_column="o_orderdate", facts_key="o_custkey")
    return kpi.values_only(results).select("request_id", "kpi_id", "value")


@query("kpi_request_flags", """
    SELECT request_id, CAST(COALESCE(COUNT(f), 0) AS INTEGER) AS flag_count,
           COALESCE(string_agg(kpi_id || ': ' || f, ' | ' ORDER BY position, i), '') AS data_quality_flags
    FROM (SELECT request_id, kpi_id, position, f, i FROM supplier_kpis
          LEFT JOIN LATERAL (SELECT unnest(report_texts) AS f, generate_subscripts(report_texts, 1) AS i) ON TRUE)
    GROUP BY request_id""", SUPPLIER_KPIS)
def kpi_request_flags(spark, sf_dir):
    flags = kpi.report_flags(supplier_results(spark, sf_dir), ["request_id"])
    return flags.select("request_id", "flag_count", text_of("data_quality_flags"))


@query("unknown_kpis", """
    SELECT request_id, position, kpi_id, kpi_id || ': not found in catalog' AS flag FROM requested
    WHERE kpi_id NOT IN (SELECT kpi_id FROM part_catalog)""")
def unknown_kpis(spark, sf_dir):
    return kpi.unknown_kpis(table(spark, sf_dir, "requested"), table(spark, sf_dir, "part_catalog")) \
        .select("request_id", "position", "kpi_id", "flag")


def _event_rates(group: str, columns: str) -> str:
    return f"""
        SELECT {columns}, 'error_rate' AS kpi_id, ROUND(e, 4) AS value, {range_sql('e', '0', '0.1')} AS flags
        FROM (SELECT {columns}, COUNT(*) FILTER (event_type = 'error') / COUNT(*) AS e
              FROM (SELECT *, {group} FROM events) GROUP BY {columns})"""


@query("kpi_weekly_trend", _event_rates("date_trunc('week', ts)::TIMESTAMP AS period", "period") + f"""
    UNION ALL SELECT period, 'purchase_per_view',
        CASE WHEN w > 0 THEN ROUND(p / w, 4) END,
        CASE WHEN w = 0 THEN 'denominator is zero' ELSE {range_sql('(p / w)', '1', None)} END
    FROM (SELECT date_trunc('week', ts)::TIMESTAMP AS period, COUNT(*) FILTER (event_type = 'purchase') AS p,
                 COUNT(*) FILTER (event_type = 'view') AS w FROM events GROUP BY ALL)""")
def kpi_weekly_trend(spark, sf_dir):
    trend = kpi.kpi_trend(marked_events(spark, sf_dir), "ts", "weekly", EVENT_KPIS, CATALOG, MAPPING)
    return trend.select(F.col("period").cast("timestamp_ntz").alias("period"), "kpi_id", "value",
                        text_of("flags"))


@query("kpi_daily_by_user", _event_rates(
    "date_trunc('day', ts)::TIMESTAMP AS period", "period, user_id"))
def kpi_daily_by_user(spark, sf_dir):
    trend = kpi.kpi_trend(marked_events(spark, sf_dir), "ts", "daily", ["error_rate"], CATALOG,
                          MAPPING, ["user_id"])
    return trend.select(F.col("period").cast("timestamp_ntz").alias("period"), "user_id", "kpi_id",
                        "value", text_of("flags"))


@query("kpi_by_dimension", f"""
    SELECT l_returnflag, 'avg_unit_price' AS kpi_id, ROUND(v, 4) AS value, {range_sql('v', '0', '1000')} AS flags
    FROM (SELECT l_returnflag, {sum_sql('l_extendedprice')} / {sum_sql('l_quantity')} AS v
          FROM lineitem GROUP BY l_returnflag)
    UNION ALL SELECT l_returnflag, 'gross_sales', ROUND({sum_sql('l_extendedprice')}, 4), ''
    FROM lineitem GROUP BY l_returnflag""")
def kpi_by_dimension(spark, sf_dir):
    results = kpi.compute_kpis(line_items(spark, sf_dir), ["gross_sales", "avg_unit_price"], CATALOG,
                               MAPPING, ["l_returnflag"])
    return results.select("l_returnflag", "kpi_id", "value", text_of("flags"))


_CUBE_SETS = ", ".join(
    f"({', '.join([g, *kept])})" for g in ("d", "w", "m")
    for kept in ([], ["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]))


@query("kpi_cube", f"""
    WITH f AS (SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS d, date_trunc('week', l_shipdate)::TIMESTAMP AS w,
                      date_trunc('month', l_shipdate)::TIMESTAMP AS m, * FROM lineitem),
    c AS (SELECT CASE WHEN GROUPING(d) = 0 THEN 'daily' WHEN GROUPING(w) = 0 THEN 'weekly' ELSE 'monthly' END AS granularity,
                 COALESCE(d, w, m) AS period, l_returnflag, l_linestatus,
                 concat_ws(',', CASE WHEN GROUPING(l_returnflag) = 0 THEN 'l_returnflag' END,
                           CASE WHEN GROUPING(l_linestatus) = 0 THEN 'l_linestatus' END) AS level,
                 {cents_sql('l_quantity')} AS units, {cents_sql('l_extendedprice')} AS price, COUNT(*) AS lines
          FROM f GROUP BY GROUPING SETS ({_CUBE_SETS})),
    v AS (SELECT *, units / lines AS v FROM c)
    SELECT granularity, period, l_returnflag, l_linestatus, level, 'units_sold' AS kpi_id, units AS value, '' AS flags FROM v
    UNION ALL SELECT granularity, period, l_returnflag, l_linestatus, level, 'gross_sales', price, '' FROM v
    UNION ALL SELECT granularity, period, l_returnflag, l_linestatus, level, 'units_per_line', {rounded_sql('v')},
                     {range_sql('v', '0', '30', rounded_sql('v'))} FROM v""")
def kpi_cube(spark, sf_dir):
    """Units, sales and units a line of all line items by day, week and month, by each subset of two dimensions.

    The ratio is one of whole numbers: ratios of prices of a day's few lines are often ties of the fourth place, which the
    last bit of a sum decides.
    """
    catalog = CATALOG | {"units_per_line": kpi.KpiDef("units_per_line", "l_quantity", "one", min=0, max=30)}
    mapping = MAPPING | {"units_per_line": kpi.ColumnMapping(None, "l_quantity", "one")}
    cube = kpi.kpi_cube(line_items(spark, sf_dir).withColumn("one", F.lit(1)), "l_shipdate",
                        ["units_sold", "gross_sales", "units_per_line"], catalog, mapping, ["l_returnflag", "l_linestatus"])
    return cube.select("granularity", "period", "l_returnflag", "l_linestatus", "level", "kpi_id", "value", text_of("flags"))


@query("kpi_multi_breakdown", " UNION ALL ".join(f"""
    SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS period, l_returnflag, l_linestatus, '{k}' AS kpi_id,
           ROUND({v}, 4) AS value FROM lineitem GROUP BY ALL""" for k, v in [
    ("gross_sales", sum_sql("l_extendedprice")), ("units_sold", sum_sql("l_quantity")),
    ("tax_to_discount", f"CASE WHEN {sum_sql('l_discount')} <> 0 THEN {sum_sql('l_tax')} / {sum_sql('l_discount')} END"),
]))
def kpi_multi_breakdown(spark, sf_dir):
    trend = kpi.kpi_trend(
        line_items(spark, sf_dir), "l_shipdate", "monthly",
        ["gross_sales", "units_sold", "tax_to_discount"], CATALOG, MAPPING,
        ["l_returnflag", "l_linestatus"])
    return trend.select(F.col("period").cast("timestamp_ntz").alias("period"), "l_returnflag",
                        "l_linestatus", "kpi_id", "value")


@query("kpi_period_filtered", f"""
    SELECT 'order_value' AS kpi_id, COALESCE(ROUND({sum_sql('o_totalprice')}, 4), 0) AS value FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'""")
def kpi_period_filtered(spark, sf_dir):
    orders = kpi.within_period(table(spark, sf_dir, "orders"), "o_orderdate", "1997-01-01", "1997-06-30")
    return kpi.compute_kpis(orders, ["order_value"], CATALOG, MAPPING).select("kpi_id", "value")


@query("kpi_period_delta", f"""
    SELECT *, CASE WHEN previous <> 0 THEN (value - previous) / previous END AS delta,
           COALESCE(ABS((value - previous) / NULLIF(previous, 0)) > 0.5, FALSE) AS large_change
    FROM (SELECT t.*, p.value AS previous FROM weekly t
          LEFT JOIN weekly p ON p.event_type = t.event_type AND p.period = t.period - INTERVAL 7 DAY)""", {"weekly": f"""
    SELECT date_trunc('week', ts)::TIMESTAMP AS period, event_type, ROUND({sum_sql('value')}, 4) AS value
    FROM events WHERE event_type <> 'view' OR week(ts) % 3 <> 0 GROUP BY 1, 2"""})
def kpi_period_delta(spark, sf_dir):
    """Weekly change per event type; views have weeks without facts, which break the comparison."""
    from kpiloom.operators.kpi import ColumnMapping, KpiDef

    trend = kpi.kpi_trend(
        table(spark, sf_dir, "events").where("event_type <> 'view' OR weekofyear(ts) % 3 <> 0"),
        "ts", "weekly", ["event_value"],
        {"event_value": KpiDef("event_value", "value")}, {"event_value": ColumnMapping("value")},
        ["event_type"])
    return kpi.period_delta(trend, ["event_type"], granularity="weekly").select(
        F.col("period").cast("timestamp_ntz").alias("period"), "event_type", "value", "previous",
        "delta", "large_change")


FORMULAS = [
    ("net_share", "net_share = (l_extendedprice - l_tax * 100) / l_extendedprice"),
    ("per_unit", "l_extendedprice / l_quantity + 1"),
    ("never", "never = l_quantity / zero"),
    ("gap", "gap = l_quantity / no_such_column"),
]


@query("recipe_formula_kpis", f"""
    SELECT l_returnflag, name, ROUND(value, 4) AS value, flags FROM (
        SELECT l_returnflag, unnest([
            {{'name': 'net_share', 'value': (p - t * 100) / p, 'flags': ''}},
            {{'name': 'per_unit', 'value': p / q + 1, 'flags': ''}},
            {{'name': 'never', 'value': NULL, 'flags': 'denominator is zero'}},
            {{'name': 'gap', 'value': NULL, 'flags': 'column ''no_such_column'' missing'}}], recursive := true)
        FROM (SELECT l_returnflag, {sum_sql('l_extendedprice')} AS p, {sum_sql('l_quantity')} AS q,
                     {sum_sql('l_tax')} AS t FROM lineitem GROUP BY l_returnflag))""")
def recipe_formula_kpis(spark, sf_dir):
    results = recipe.formula_kpis(line_items(spark, sf_dir), FORMULAS, ["l_returnflag"])
    return results.select("l_returnflag", "name", "value", text_of("flags"))


@query("recipe_filters", f"""
    SELECT o_orderpriority, ROUND({sum_sql('o_totalprice')}, 4) AS value FROM orders
    WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '5-LOW')
    GROUP BY o_orderpriority""")
def recipe_filters(spark, sf_dir):
    orders = recipe.apply_filters(
        table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"],
        {"o_orderstatus": ["F", "P"], "o_orderpriority": ["1-URGENT", "5-LOW"]})
    return kpi.compute_kpis(orders, ["order_value"], CATALOG, MAPPING, ["o_orderpriority"]) \
        .select("o_orderpriority", "value")


@query("recipe_run", f"""
    SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS period, o_orderpriority, 'mean_value' AS name,
           ROUND({sum_sql('o_totalprice')} / {sum_sql('o_custkey')}, 4) AS value
    FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'
    GROUP BY ALL HAVING SUM(o_custkey) <> 0""")
def recipe_run(spark, sf_dir):
    config = {
        "date_column": "o_orderdate", "granularity": "monthly", "dimensions": ["o_orderpriority"],
        "filters": ["o_orderstatus"],
        "kpis": [{"name": "mean_value", "formula": "mean_value = o_totalprice / o_custkey"}],
    }
    results = recipe.run_recipe(table(spark, sf_dir, "orders"), config, {"o_orderstatus": ["F"]},
                                ("1996-01-01", None))
    return results.where(F.col("value").isNotNull()).select(
        F.col("period").cast("timestamp_ntz").alias("period"), "o_orderpriority", "name", "value")


@query("renamed_columns", """
    SELECT p_partkey AS part_number, p_name AS label, p_retailprice AS price FROM part""")
def renamed_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return recipe.rename_columns(
        part, {"p_partkey": "part_number", "p_name": "label", "p_retailprice": "price"})


@query("derived_columns", """
    SELECT o_orderkey, o_totalprice / 100 AS price_in_hundreds, year(o_orderdate) AS order_year,
           o_orderstatus || '/' || o_orderpriority AS state FROM orders""")
def derived_columns(spark, sf_dir):
    orders = recipe.derive_columns(table(spark, sf_dir, "orders"), {
        "price_in_hundreds": F.col("o_totalprice") / 100,
        "order_year": F.year("o_orderdate").cast("bigint"),
        "state": F.concat("o_orderstatus", F.lit("/"), "o_orderpriority"),
    })
    return orders.select("o_orderkey", "price_in_hundreds", "order_year", "state")
