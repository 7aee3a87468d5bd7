"""KPI catalog: filters, validation, ids, defaults, maintenance and template checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kpiloom.functions.running import BLOCK_ROWS, neighbour, running_total
from kpiloom.functions.text import slug
from kpiloom.schemas import (
    ANY_KPI, KPI_DOMAINS, KPI_FORMATS, NO_DENOMINATOR, RANGE,
)

REQUIRED_FIELDS = ["kpi_id", "display_name", "numerator", "denominator", "format", "domain"]


def in_domain(catalog: DataFrame, domain: str | None = None,
              reviewed: bool | None = None) -> DataFrame:
    if domain:
        catalog = catalog.where(F.col("domain") == domain)
    if reviewed is not None:
        catalog = catalog.where(F.col("reviewed") == reviewed)
    return catalog


def ordered(catalog: DataFrame) -> DataFrame:
    """By domain and display name in binary order."""
    return catalog.orderBy("domain", "display_name")


def restrict_to(catalog: DataFrame, requested: DataFrame) -> DataFrame:
    """Catalog rows that some request names."""
    return catalog.join(requested.select("kpi_id"), "kpi_id", "left_semi")


def head_records(df: DataFrame, order_by: list[str], n: int = 3) -> DataFrame:
    """First rows of a file as JSON records; only ``n`` rows leave each task."""
    return (
        df.orderBy(*order_by).limit(n)
        .select(*order_by, F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
                .alias("record"))
    )


def decode_control_columns(rows: DataFrame) -> DataFrame:
    """Catalog rows as stored, with JSON texts and a 0/1 flag, to typed columns."""
    def listed(name: str) -> Column:
        return F.coalesce(F.from_json(F.nullif(F.col(name), F.lit("")), "ARRAY<STRING>"),
                          F.array().cast("array<string>"))

    return rows.withColumns({
        "expected_range": F.from_json(F.nullif(F.col("expected_range"), F.lit("")), RANGE),
        "aliases": listed("aliases"),
        "source_fields": listed("source_fields"),
        "reviewed": F.coalesce(F.col("reviewed"), F.lit(0)).cast("boolean"),
    })


def encode_control_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "expected_range": F.to_json("expected_range"),
        "aliases": F.to_json("aliases"),
        "source_fields": F.to_json("source_fields"),
        "reviewed": F.col("reviewed").cast("int"),
    })


def _choices(values: list[str]) -> str:
    return str(values)


def definition_error(display_name: Column, format: Column, domain: Column) -> Column:
    """First thing wrong with a proposed KPI: format, then domain, then its id."""
    def invalid(kind: str, value: Column, allowed: list[str]) -> Column:
        shown = F.coalesce(value, F.lit("None"))
        return F.concat(F.lit(f"Invalid {kind} '"), shown,
                        F.lit(f"'. Choose from: {_choices(allowed)}"))

    def outside(value: Column, allowed: list[str]) -> Column:
        return ~F.coalesce(value.isin(allowed), F.lit(False))

    return (
        F.when(outside(format, KPI_FORMATS), invalid("format", format, KPI_FORMATS))
        .when(outside(domain, KPI_DOMAINS), invalid("domain", domain, KPI_DOMAINS))
        .when(slug(F.coalesce(display_name, F.lit(""))) == "",
              F.lit("Could not generate a valid kpi_id from the display name."))
    )


def missing_fields_error(row_columns: list[str] = REQUIRED_FIELDS) -> Column:
    """Message naming the required fields that are absent or empty, in field order."""
    gaps = F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"'{c}'")) for c in row_columns
    ]))
    return F.when(F.size(gaps) > 0, F.concat(
        F.lit("Missing required fields: ["), F.array_join(gaps, ", "), F.lit("]")))


def expected_range(low: Column, high: Column) -> Column:
    """The bounds given, or null when there are none."""
    return F.when(low.isNotNull() | high.isNotNull(),
                  F.struct(low.cast("double").alias("min"), high.cast("double").alias("max")))


def enrich_source_fields(source_fields: Column, numerator: Column, denominator: Column) -> Column:
    """Numerator and denominator appended where named and not yet listed."""
    given = F.coalesce(source_fields, F.array().cast("array<string>"))

    def with_one(fields: Column, name: Column) -> Column:
        wanted = (F.coalesce(name, F.lit("")) != "") & (name != NO_DENOMINATOR)
        return F.when(wanted & ~F.array_contains(fields, F.coalesce(name, F.lit(""))),
                      F.array_append(fields, name)).otherwise(fields)

    return with_one(with_one(given, numerator), denominator)


def assign_ids(proposals: DataFrame, catalog: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Catalog ids of proposed KPIs (seq, display_name) in arrival order.

    The first free of ``slug, slug_2, slug_3, …`` is taken; a name without letters or digits gets
    none. Ids in the catalog are not free, and neither is a numbered id that is another
    proposal's own slug, so all ids of a batch differ. One name proposed by a third of all rows
    is numbered in blocks of arrivals, not in one task.
    """
    slugged = proposals.withColumn("slug", slug(F.coalesce("display_name", F.lit(""))))
    named = slugged.where(F.col("slug") != "")
    proposed = proposals.count()
    known = proposed + catalog.count()
    arrivals = running_total(
        named.withColumn("_one", F.lit(1)), ["slug"], "seq", "_one", "arrival", rows, proposed
    ).drop("_one")

    numbered = r"^(.+)_([2-9]|[1-9][0-9]{1,17})$"
    in_use = catalog.select(F.col("kpi_id").alias("id"))
    own = named.select(F.col("slug").alias("id")).distinct()
    later = in_use.unionByName(own).select(
        F.regexp_extract("id", numbered, 1).alias("slug"),
        F.regexp_extract("id", numbered, 2).alias("n"),
    ).where(F.col("n") != "").withColumn("n", F.col("n").cast("bigint"))
    first = in_use.select(F.col("id").alias("slug"), F.lit(1).cast("bigint").alias("n"))
    blocked = (
        first.unionByName(later).distinct()
        .join(own.withColumnRenamed("id", "slug"), "slug", "left_semi")
    )
    # The j-th blocked number n of a slug moves every arrival past its n - j free numbers up by one.
    ranked = running_total(blocked.withColumn("_one", F.lit(1)), ["slug"], "n", "_one", "j", rows, known)
    moves = (
        ranked.groupBy("slug", (F.col("n") - F.col("j") + 1).alias("arrival"))
        .agg(F.count(F.lit(1)).alias("_move"))
    )
    placed = (
        arrivals.join(moves, ["slug", "arrival"], "full_outer")
        .withColumn("_move", F.coalesce("_move", F.lit(0)))
    )
    moved = running_total(placed, ["slug"], "arrival", "_move", "_shift", rows, proposed + known)
    number = F.col("arrival") + F.col("_shift")
    ids = moved.where(F.col("seq").isNotNull()).withColumn(
        "kpi_id",
        F.when(number == 1, F.col("slug"))
        .otherwise(F.concat("slug", F.lit("_"), number.cast("string"))),
    ).drop("_move", "_shift", "arrival")
    unnamed = slugged.where(F.col("slug") == "").withColumn("kpi_id", F.lit(None).cast("string"))
    return ids.unionByName(unnamed)


def insert_if_absent(catalog: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows in conflict, by ``kpi_id``; the first arrival (``seq``) of an id wins."""
    firsts = incoming.groupBy("kpi_id").agg(F.min("seq").alias("seq"))
    new_ids = firsts.join(catalog.select("kpi_id"), "kpi_id", "left_anti")
    inserted = incoming.join(new_ids, ["kpi_id", "seq"], "left_semi")
    conflicts = incoming.join(new_ids, ["kpi_id", "seq"], "left_anti").withColumn(
        "error", F.concat(F.lit("KPI '"), "kpi_id", F.lit("' already exists.")))
    return inserted, conflicts


def promote(catalog: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewed flag from the latest decision per KPI (kpi_id, seq, reviewed; null means true)."""
    latest = decisions.groupBy("kpi_id").agg(
        F.max_by(F.coalesce("reviewed", F.lit(True)), "seq").alias("_decided"))
    return (
        catalog.join(latest, "kpi_id", "left")
        .withColumn("reviewed", F.coalesce("_decided", "reviewed")).drop("_decided")
    )


def template_kpi_menu(templates: DataFrame, catalog: DataFrame) -> DataFrame:
    """KPIs a template offers, required and optional, resolved against the catalog.

    The wildcard offers the whole catalog: template documents are few, so each catalog row
    is expanded in place and the catalog is not moved.
    """
    def listed(column: str, kind: str) -> DataFrame:
        return templates.select("template_id", F.lit(kind).alias("kind"),
                                F.explode(column).alias("kpi_id"))

    named = (
        listed("required_kpis", "required").unionByName(listed("optional_kpis", "optional"))
        .where(F.col("kpi_id") != ANY_KPI)
    )
    details = catalog.select("kpi_id", "display_name", "format")
    menu = named.join(details, "kpi_id", "left").select(
        "template_id", "kind", "kpi_id", "display_name", "format",
        F.col("display_name").isNotNull().alias("in_catalog"),
    )
    open_ids = [
        r["template_id"]
        for r in templates.where(F.array_contains("optional_kpis", ANY_KPI))
        .select("template_id").collect()
    ]
    if not open_ids:
        return menu
    everything = details.select(
        F.explode(F.array(*[F.lit(t) for t in open_ids])).alias("template_id"),
        F.lit("optional").alias("kind"), "kpi_id", "display_name", "format",
        F.lit(True).alias("in_catalog"),
    )
    return menu.unionByName(everything)


def template_coverage(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Required KPIs not asked for and required dimensions not in the headers, per request."""
    needed = templates.select(
        F.col("template_id").alias("template_type"), "required_kpis", "required_dimensions")
    return (
        requests.join(needed, "template_type", "left")
        .withColumn("missing_kpis", F.array_except("required_kpis", "kpi_list"))
        .withColumn("missing_dimensions", F.array_except("required_dimensions", "headers"))
        .withColumn("covered", (F.size("missing_kpis") == 0) & (F.size("missing_dimensions") == 0))
        .drop("required_kpis", "required_dimensions")
    )


def definition_history(changes: DataFrame, keys: list[str], seq: str = "seq",
                       at: str = "changed_at", rows: int = BLOCK_ROWS) -> DataFrame:
    """Validity interval of each distinct successive formula of a KPI; the last one is open."""
    size = changes.count()
    before = neighbour(changes.withColumn("_seen", F.struct("formula")), keys, seq, "_seen", "_before",
                       previous=True, rows=rows, size=size)
    changed = before.where(F.col("_before").isNull()
                           | ~F.col("formula").eqNullSafe(F.col("_before.formula")))
    return (
        neighbour(changed.drop("_seen", "_before"), keys, seq, at, "valid_to", previous=False, rows=rows, size=size)
        .withColumnRenamed(at, "valid_from")
    )
