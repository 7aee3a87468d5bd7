"""Header matching, mapping merges, mapping memory, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.operators import mapping
from kpiloom.plans.fixtures import catalog_frame
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table

ITEM_LIST = ["gross_sales", "units_sold", "avg_unit_price", "tax_to_discount", "error_rate", "zero_den"]


def matched(spark, sf_dir):
    """Headers are the part names of each order; KPIs are asked for by order priority."""
    requests = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("upload_id"),
        F.when(F.col("o_orderpriority") < "3", F.array(*[F.lit(k) for k in ITEM_LIST[:4]]))
        .otherwise(F.array(*[F.lit(k) for k in ITEM_LIST[2:]])).alias("kpi_list"))
    return mapping.match_headers(table(spark, sf_dir, "file_headers"), requests, catalog_frame(spark))


@query("header_match")
def header_match(spark, sf_dir):
    return matched(spark, sf_dir)


@query("review_load")
def review_load(spark, sf_dir):
    return mapping.review_load(matched(spark, sf_dir))


@query("header_match_exact", """
    SELECT l_orderkey * 10 + l_linenumber AS upload_id, 'kpi_' || CAST(l_partkey AS STRING) AS kpi_id,
           CASE l_linenumber % 3 WHEN 0 THEN upper(c.numerator) WHEN 1 THEN '  ' || c.numerator || ' ' END AS raw_column,
           CASE WHEN l_linenumber % 3 < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence, l_linenumber % 3 = 2 AS needs_review
    FROM lineitem JOIN part_catalog c ON c.p_partkey = l_partkey""")
def header_match_exact(spark, sf_dir):
    """One upload per line item that asks for its part's KPI: a header is the KPI's numerator in another case
    or padded, twice over so that the first must win, or shares no letter with it."""
    catalog = table(spark, sf_dir, "part_catalog").withColumns({
        "source_fields": F.array().cast("array<string>"), "aliases": F.array("numerator")})
    items = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("upload_id"),
        F.concat(F.lit("kpi_"), F.col("l_partkey").cast("string")).alias("kpi_id"),
        (F.col("l_linenumber") % 3).alias("kind")).join(catalog.select("kpi_id", "numerator"), "kpi_id")
    copy = F.when(F.col("kind") == 0, F.upper("numerator")).when(
        F.col("kind") == 1, F.concat(F.lit("  "), "numerator", F.lit(" "))).otherwise("~~~")
    headers = items.repartition("upload_id").select("upload_id", F.posexplode(F.array(
        F.lit("###"), copy, F.when(F.col("kind") < 2, F.col("numerator")).otherwise("^^^"))).alias("position", "header"))
    requests = items.select("upload_id", F.array("kpi_id", F.lit("no_such_kpi")).alias("kpi_list"))
    return mapping.match_headers(headers, requests, catalog, settle=True)


REVIEWS = {"checked_mappings": """
    SELECT l_orderkey AS upload_id, (l_extendedprice < 20000) AS needs_review FROM lineitem"""}


@query("review_counts", """
    SELECT upload_id, COUNT(*) FILTER (needs_review) AS needs_review_count,
           CASE WHEN COUNT(*) FILTER (needs_review) > 0
                THEN CAST(COUNT(*) FILTER (needs_review) AS STRING) || ' mapping(s) need user confirmation (confidence < 0.7).'
                ELSE 'All mappings auto-resolved. Please confirm to proceed.' END AS message
    FROM checked_mappings GROUP BY upload_id""", REVIEWS)
def review_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_extendedprice") < 20000).alias("needs_review"))
    return mapping.review_load(rows)


@query("mapping_coverage", """
    SELECT upload_id, COUNT(*) FILTER (NOT needs_review) AS mapped, COUNT(*) AS total,
           COUNT(*) FILTER (NOT needs_review) / COUNT(*) AS share,
           COUNT(*) FILTER (NOT needs_review) / COUNT(*) < 0.7 AS escalate
    FROM checked_mappings GROUP BY upload_id""", REVIEWS)
def mapping_coverage(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("upload_id"), (F.col("l_extendedprice") < 20000).alias("needs_review"))
    return mapping.mapping_coverage(rows)


@query("mapped_column_check", """
    SELECT m.upload_id, m.kpi_id, n.header IS NOT NULL AS has_numerator, d.header IS NOT NULL AS has_denominator,
           CASE WHEN n.header IS NULL AND m.is_total THEN 'column ''' || m.numerator_column || ''' missing'
                WHEN n.header IS NULL THEN 'numerator column ''' || m.numerator_column || ''' missing'
                WHEN NOT m.is_total AND d.header IS NULL
                THEN 'denominator column ''' || COALESCE(m.denominator_column, 'None') || ''' missing' END AS flag
    FROM file_mappings m
    LEFT JOIN file_headers n ON n.upload_id = m.upload_id AND n.header = m.numerator_column
    LEFT JOIN file_headers d ON d.upload_id = m.upload_id AND d.header = m.denominator_column""")
def mapped_column_check(spark, sf_dir):
    return mapping.check_mapped_columns(
        table(spark, sf_dir, "file_mappings"), table(spark, sf_dir, "file_headers"), ["kpi_id"])


def records(spark, sf_dir):
    current = table(spark, sf_dir, "mapping_current").select("request_id", "kpi_id", F.create_map(
        F.lit("raw_column"), "raw_column", F.lit("confidence"), "confidence").alias("record"))
    none = F.lit(None).cast("string")
    incoming = table(spark, sf_dir, "mapping_incoming").select("request_id", "kpi_id", F.when(
        F.col("clears_raw"),
        F.create_map(F.lit("denominator_column"), "denominator_column", F.lit("raw_column"), none),
    ).otherwise(F.create_map(F.lit("denominator_column"), "denominator_column")).alias("record"))
    return current, incoming


def as_fields(merged):
    return merged.select("request_id", "kpi_id", *[
        F.try_element_at("record", F.lit(f)).alias(f)
        for f in ("raw_column", "confidence", "denominator_column")])


@query("mapping_merge_shallow", """
    SELECT request_id, kpi_id, CASE WHEN i.clears_raw IS NULL THEN c.raw_column END AS raw_column,
           CASE WHEN i.clears_raw IS NULL THEN c.confidence END AS confidence, i.denominator_column
    FROM mapping_current c FULL JOIN mapping_incoming i USING (request_id, kpi_id)""")
def mapping_merge_shallow(spark, sf_dir):
    return as_fields(mapping.merge_whole(*records(spark, sf_dir), ["request_id", "kpi_id"]))


@query("mapping_merge_deep", """
    SELECT request_id, kpi_id, CASE WHEN i.clears_raw THEN NULL ELSE c.raw_column END AS raw_column,
           c.confidence, i.denominator_column
    FROM mapping_current c FULL JOIN mapping_incoming i USING (request_id, kpi_id)""")
def mapping_merge_deep(spark, sf_dir):
    return as_fields(mapping.merge_fields(*records(spark, sf_dir), ["request_id", "kpi_id"]))


@query("schema_memory_lookup", """
    SELECT r.request_id, m.client_id IS NOT NULL AS exists, m.mappings, m.use_count
    FROM requests r LEFT JOIN memory m ON m.client_id = r.client_id AND m.template_type = r.template_type""")
def schema_memory_lookup(spark, sf_dir):
    found = mapping.lookup_memory(table(spark, sf_dir, "requests"), table(spark, sf_dir, "memory"))
    return found.select("request_id", "exists", "mappings", "use_count")


@query("schema_memory_upsert", """
    SELECT client_id, template_type, COALESCE(a.mappings, m.mappings) AS mappings,
           COALESCE(a.approved_by, m.approved_by) AS approved_by,
           CAST(COALESCE(m.use_count, 0) + COALESCE(a.uses, 0) AS BIGINT) AS use_count
    FROM memory m FULL JOIN (
        SELECT client_id, template_type, arg_max(mappings, seq) AS mappings, arg_max(approved_by, seq) AS approved_by,
               COUNT(*) AS uses FROM approvals GROUP BY client_id, template_type) a
    USING (client_id, template_type)""")
def schema_memory_upsert(spark, sf_dir):
    return mapping.upsert_memory(table(spark, sf_dir, "memory"), table(spark, sf_dir, "approvals"))


@query("header_drift", """
    SELECT s_suppkey AS upload_id, array_to_string(list_sort(list_filter(a, lambda h: NOT list_contains(b, h))), ',') AS gone,
           array_to_string(list_sort(list_filter(b, lambda h: NOT list_contains(a, h))), ',') AS added,
           len(list_filter(a, lambda h: NOT list_contains(b, h))) = 0 AND len(list_filter(b, lambda h: NOT list_contains(a, h))) = 0 AS same
    FROM (SELECT s_suppkey, ['date', 'site', 'col_' || CAST(s_nationkey % 3 AS STRING)] AS a,
                 ['site', 'date', 'col_' || CAST(s_suppkey % 3 AS STRING)] AS b FROM supplier)""")
def header_drift(spark, sf_dir):
    def numbered(column):
        return F.concat(F.lit("col_"), (F.col(column) % 3).cast("string"))

    gone, added, same = mapping.header_drift(
        F.array(F.lit("date"), F.lit("site"), numbered("s_nationkey")),
        F.array(F.lit("site"), F.lit("date"), numbered("s_suppkey")))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("upload_id"), F.array_join(F.array_sort(gone), ",").alias("gone"),
        F.array_join(F.array_sort(added), ",").alias("added"), same.alias("same"))
