"""Catalog filters, validation, ids, decoding and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.operators import catalog
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table
from kpiloom.schemas import KPI_DOMAINS, KPI_FORMATS
from kpiloom.session import scratch_path
from kpiloom.sources import snapshots
from kpiloom.sources.catalog_files import read_catalog, replace_catalog, stored_catalog
from kpiloom.sources.sinks import write_documents


def quoted_list(values: list[str]) -> str:
    return str(values).replace("'", "''")


@query("catalog_by_domain", """
    SELECT kpi_id, display_name, format, domain FROM part_catalog WHERE domain = 'cx' AND reviewed""")
def catalog_by_domain(spark, sf_dir):
    rows = catalog.in_domain(table(spark, sf_dir, "part_catalog"), "cx", reviewed=True)
    return rows.select("kpi_id", "display_name", "format", "domain")


@query("catalog_ordered", "SELECT domain, display_name, kpi_id FROM part_catalog")
def catalog_ordered(spark, sf_dir):
    return catalog.ordered(table(spark, sf_dir, "part_catalog")).select("domain", "display_name", "kpi_id")


@query("head_records", """
    SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3""")
def head_records(spark, sf_dir):
    """The first three rows are the feature: what a person sees of a new file."""
    head = catalog.head_records(table(spark, sf_dir, "orders"), ["o_orderkey"])
    return head.select("o_orderkey", F.from_json("record", "o_orderstatus STRING, o_totalprice DOUBLE")
                       .alias("r")).select("o_orderkey", "r.*")


@query("catalog_restriction", """
    SELECT kpi_id, display_name FROM part_catalog
    WHERE kpi_id IN (SELECT 'kpi_' || CAST(o_custkey AS STRING) FROM orders WHERE o_orderstatus = 'F')""")
def catalog_restriction(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("kpi_"), F.col("o_custkey").cast("string")).alias("kpi_id"))
    return catalog.restrict_to(table(spark, sf_dir, "part_catalog"), asked).select("kpi_id", "display_name")


SLUG_SQL = "trim(regexp_replace(lower(display_name), '[^a-z0-9]+', '_', 'g'), '_')"


@query("kpi_validation", f"""
    SELECT seq, CASE
        WHEN format NOT IN ('percentage', 'integer', 'currency', 'duration')
        THEN 'Invalid format ''' || format || '''. Choose from: {quoted_list(KPI_FORMATS)}'
        WHEN domain NOT IN ('collections', 'cx', 'sales', 'workforce', 'ops')
        THEN 'Invalid domain ''' || domain || '''. Choose from: {quoted_list(KPI_DOMAINS)}'
        WHEN {SLUG_SQL} = '' THEN 'Could not generate a valid kpi_id from the display name.' END AS error
    FROM proposals""")
def kpi_validation(spark, sf_dir):
    error = catalog.definition_error(F.col("display_name"), F.col("format"), F.col("domain"))
    return table(spark, sf_dir, "proposals").select("seq", error.alias("error"))


@query("kpi_required_fields", """
    SELECT seq, CASE WHEN len(gaps) > 0 THEN 'Missing required fields: [' || array_to_string(gaps, ', ') || ']' END AS error
    FROM (SELECT seq, list_filter([
            CASE WHEN COALESCE(numerator, '') = '' THEN '''numerator''' END,
            CASE WHEN COALESCE(denominator, '') = '' THEN '''denominator''' END], lambda g: g IS NOT NULL) AS gaps
          FROM proposals)""")
def kpi_required_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "proposals").withColumn(
        "kpi_id", F.concat(F.lit("kpi_"), F.col("seq").cast("string")))
    return rows.select("seq", catalog.missing_fields_error().alias("error"))


SLUGS = {
    "slugs": f"SELECT seq, {SLUG_SQL} AS slug FROM proposals",
    "taken": """SELECT kpi_id AS id FROM existing UNION SELECT slug FROM slugs WHERE slug <> ''""",
    "existing": """
        SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '_')
               || CASE WHEN p_size % 3 = 0 THEN '' ELSE '_' || CAST(p_size % 7 + 2 AS STRING) END AS kpi_id
        FROM part""",
    "blocked": """
        SELECT DISTINCT slug, n FROM (
            SELECT kpi_id AS slug, 1 AS n FROM existing
            UNION ALL
            SELECT regexp_extract(id, '^(.+)_([2-9]|[1-9][0-9]+)$', 1),
                   TRY_CAST(regexp_extract(id, '^(.+)_([2-9]|[1-9][0-9]+)$', 2) AS BIGINT) FROM taken)
        WHERE n IS NOT NULL AND slug IN (SELECT slug FROM slugs)""",
    "arrivals": """
        SELECT seq, slug, ROW_NUMBER() OVER (PARTITION BY slug ORDER BY seq) AS k FROM slugs WHERE slug <> ''""",
    "free": """
        SELECT slug, n, ROW_NUMBER() OVER (PARTITION BY slug ORDER BY n) AS k FROM (
            SELECT g.slug, CAST(g.n AS BIGINT) AS n FROM (
                SELECT slug, unnest(range(1, most + 1)) AS n FROM (
                    SELECT a.slug, MAX(a.k) + (SELECT COUNT(*) FROM blocked b WHERE b.slug = a.slug) AS most
                    FROM arrivals a GROUP BY a.slug)) g
            ANTI JOIN blocked b ON b.slug = g.slug AND b.n = g.n)""",
}


@query("kpi_slugs", """
    SELECT a.seq, a.slug, CASE WHEN f.n = 1 THEN a.slug ELSE a.slug || '_' || CAST(f.n AS STRING) END AS kpi_id
    FROM arrivals a JOIN free f ON f.slug = a.slug AND f.k = a.k
    UNION ALL SELECT seq, slug, NULL FROM slugs WHERE slug = ''""", SLUGS)
def kpi_slugs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    base = F.regexp_replace(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    existing = part.select(F.concat(base, F.when(F.col("p_size") % 3 == 0, "").otherwise(
        F.concat(F.lit("_"), (F.col("p_size") % 7 + 2).cast("string")))).alias("kpi_id"))
    ids = catalog.assign_ids(table(spark, sf_dir, "proposals").select("seq", "display_name"), existing)
    return ids.select("seq", "slug", "kpi_id")


@query("source_field_enrichment", """
    SELECT seq, array_to_string(list_concat(list_concat(sf,
        CASE WHEN numerator <> '' AND NOT list_contains(sf, numerator) THEN [numerator] ELSE [] END),
        CASE WHEN denominator IS NOT NULL AND denominator <> '_none_' AND NOT list_contains(sf, denominator)
             THEN [denominator] ELSE [] END), ',') AS source_fields
    FROM (SELECT seq, numerator, denominator, ['units_' || CAST(p_size - p_size % 2 AS STRING), p_name, p_name] AS sf
          FROM proposals)""")
def source_field_enrichment(spark, sf_dir):
    even = F.concat(F.lit("units_"), (F.col("p_size") - F.col("p_size") % 2).cast("string"))
    fields = catalog.enrich_source_fields(
        F.array(even, "p_name", "p_name"), F.col("numerator"), F.col("denominator"))
    return table(spark, sf_dir, "proposals").select("seq", F.array_join(fields, ",").alias("source_fields"))


@query("expected_ranges", """
    SELECT seq, low IS NULL AND high IS NULL AS unbounded, low AS min, high AS max FROM proposals""")
def expected_ranges(spark, sf_dir):
    limits = catalog.expected_range(F.col("low"), F.col("high"))
    return table(spark, sf_dir, "proposals").select("seq", limits.alias("r")).select(
        "seq", F.col("r").isNull().alias("unbounded"), "r.min", "r.max")


CATALOG_DOC = """
    SELECT p_partkey, '{"kpi_id": "' || kpi_id || '", "display_name": "' || display_name || '", "numerator": "'
        || numerator || '", "denominator": "' || denominator || '", "format": "' || format || '", "domain": "' || domain || '"'
        || CASE WHEN description IS NULL THEN '' ELSE ', "description": "' || description || '"' END
        || CASE WHEN p_size % 2 = 0 THEN ', "expected_range": {"min": 0, "max": ' || CAST(p_size AS STRING) || '}'
                WHEN p_size % 3 = 0 THEN ', "expected_range": null' ELSE ', "expected_range": {}' END
        || CASE WHEN p_size % 5 = 0 THEN ', "aliases": ["' || numerator || ' rate", "x"]' ELSE '' END
        || CASE WHEN reviewed THEN ', "reviewed": true' ELSE '' END || '}' AS document
    FROM part_catalog"""


@query("catalog_load", """
    SELECT kpi_id, COALESCE(description, '') AS description,
           CASE WHEN p_size % 2 = 0 THEN CAST(0 AS DOUBLE) END AS min,
           CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS max,
           CASE WHEN p_size % 5 = 0 THEN numerator || ' rate,x' ELSE '' END AS aliases,
           0 AS source_field_count, reviewed
    FROM part_catalog""")
def catalog_load(spark, sf_dir):
    """The catalog as documents in files, read, stored as a snapshot and read from there."""
    files, stored = scratch_path(spark, "catalog-files"), scratch_path(spark, "catalog")
    write_documents(table(spark, sf_dir, "part_catalog").select(F.expr(_doc_expression()).alias("document")), files)
    replace_catalog(read_catalog(spark, files, lines=True), stored)
    return stored_catalog(spark, stored).select(
        "kpi_id", "description", "expected_range.min", "expected_range.max",
        F.array_join("aliases", ",").alias("aliases"),
        F.size("source_fields").alias("source_field_count"), "reviewed")


@query("catalog_snapshots", """
    SELECT kpi_id, CASE WHEN p_size % 2 = 0 THEN 'second' ELSE 'first' END AS load, FALSE AS is_old FROM part_catalog
    UNION ALL SELECT kpi_id, 'first', TRUE FROM part_catalog""")
def catalog_snapshots(spark, sf_dir):
    """A snapshot, half of it changed in the next one that is made from it, and a reader that was there before."""
    root = scratch_path(spark, "snapshots")
    rows = table(spark, sf_dir, "part_catalog").select("kpi_id", "p_size", F.lit("first").alias("load"))
    snapshots.publish(rows, root)
    before = snapshots.current(spark, root)
    snapshots.publish(before.withColumn("load", F.when(F.col("p_size") % 2 == 0, "second").otherwise(F.col("load"))), root)
    now = snapshots.current(spark, root)
    return now.select("kpi_id", "load", F.lit(False).alias("is_old")).union(before.select("kpi_id", "load", F.lit(True)))


def _doc_expression() -> str:
    body = CATALOG_DOC.split("p_partkey,", 1)[1]
    return body.rsplit(" AS document", 1)[0]


@query("control_json_decode", """
    SELECT p_partkey AS row_id, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE END AS min,
           CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS max,
           CASE WHEN p_size % 3 = 0 THEN 0 ELSE 2 END AS alias_count,
           p_size % 5 = 0 AS reviewed FROM part""")
def control_json_decode(spark, sf_dir):
    size = F.col("p_size")
    stored = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.when(size % 4 == 0, F.concat(F.lit('{"min": 0.5, "max": '), size.cast("string"), F.lit("}")))
        .when(size % 2 == 0, '{"min": 0.5}').alias("expected_range"),
        F.when(size % 3 != 0, F.concat(F.lit('["'), "p_name", F.lit('", "b"]'))).alias("aliases"),
        F.when(size % 3 == 0, "").alias("source_fields"),
        F.when(size % 5 == 0, 1).when(size % 5 == 1, 0).alias("reviewed"))
    decoded = catalog.decode_control_columns(stored)
    encoded = catalog.decode_control_columns(catalog.encode_control_columns(decoded))
    return encoded.select("row_id", "expected_range.min", "expected_range.max",
                          F.size("aliases").alias("alias_count"), "reviewed")


INCOMING = {
    "existing_kpis": "SELECT kpi_id FROM part_catalog WHERE p_size > 25",
    "incoming": """SELECT 'kpi_' || CAST(o_custkey AS STRING) AS kpi_id, o_orderkey AS seq, o_orderstatus AS format FROM orders""",
    "firsts": """SELECT kpi_id, MIN(seq) AS seq FROM incoming WHERE kpi_id NOT IN (SELECT kpi_id FROM existing_kpis) GROUP BY kpi_id""",
}


@query("catalog_insert_if_absent", """
    SELECT i.seq, i.kpi_id, i.format, CASE WHEN f.seq IS NULL THEN 'KPI ''' || i.kpi_id || ''' already exists.' END AS error
    FROM incoming i LEFT JOIN firsts f ON f.kpi_id = i.kpi_id AND f.seq = i.seq""", INCOMING)
def catalog_insert_if_absent(spark, sf_dir):
    existing = table(spark, sf_dir, "part_catalog").where("p_size > 25")
    incoming = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("kpi_"), F.col("o_custkey").cast("string")).alias("kpi_id"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("format"))
    inserted, conflicts = catalog.insert_if_absent(existing, incoming)
    return inserted.withColumn("error", F.lit(None).cast("string")).unionByName(conflicts) \
        .select("seq", "kpi_id", "format", "error")


@query("kpi_promotions", """
    SELECT c.kpi_id, COALESCE(d.reviewed, c.reviewed) AS reviewed FROM part_catalog c
    LEFT JOIN (SELECT 'kpi_' || CAST(user_id AS STRING) AS kpi_id,
                      arg_max(COALESCE(CASE WHEN event_type = 'error' THEN FALSE WHEN event_type = 'view' THEN TRUE END, TRUE), event_id) AS reviewed
               FROM events GROUP BY user_id) d ON d.kpi_id = c.kpi_id""")
def kpi_promotions(spark, sf_dir):
    decisions = table(spark, sf_dir, "events").select(
        F.concat(F.lit("kpi_"), F.col("user_id").cast("string")).alias("kpi_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", False).when(F.col("event_type") == "view", True)
        .alias("reviewed"))
    return catalog.promote(table(spark, sf_dir, "part_catalog"), decisions).select("kpi_id", "reviewed")


@query("kpi_history", """
    SELECT recipe_id, name, formula, valid_from, LEAD(valid_from) OVER (PARTITION BY recipe_id, name ORDER BY seq) AS valid_to
    FROM (SELECT recipe_id, name, formula, changed_at AS valid_from, seq,
                 LAG(formula) OVER (PARTITION BY recipe_id, name ORDER BY seq) AS before FROM formula_changes)
    WHERE before IS NULL OR before <> formula""")
def kpi_history(spark, sf_dir):
    history = catalog.definition_history(
        table(spark, sf_dir, "formula_changes"), ["recipe_id", "name"])
    return history.select("recipe_id", "name", "formula", "valid_from", "valid_to")
