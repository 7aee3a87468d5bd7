"""KPI totals and ratios: one aggregate over the facts, then column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from kpiloom.functions.dates import GRAINS, grain
from kpiloom.functions.numbers import (
    exact_parts, exact_value, is_numeric, plain_number, present, ratio, round_kpi, total,
)
from kpiloom.schemas import NO_DENOMINATOR


@dataclass(frozen=True)
class KpiDef:
    kpi_id: str
    numerator: str
    denominator: str = NO_DENOMINATOR
    format: str = "percentage"
    domain: str = "ops"
    min: float | None = None
    max: float | None = None
    display_name: str | None = None
    aliases: tuple[str, ...] = ()
    source_fields: tuple[str, ...] = ()
    reviewed: bool = True
    description: str = ""


@dataclass(frozen=True)
class ColumnMapping:
    raw_column: str | None = None
    numerator_column: str | None = None
    denominator_column: str | None = None

    @property
    def numerator(self) -> str | None:
        return self.numerator_column or self.raw_column


def definitions(catalog: DataFrame, kpi_list: Sequence[str]) -> dict[str, KpiDef]:
    """The requested catalog rows on the driver; never more than the request names."""
    rows = catalog.where(F.col("kpi_id").isin(list(kpi_list))).collect()
    found = {}
    for r in rows:
        limits = r["expected_range"]
        found[r["kpi_id"]] = KpiDef(
            r["kpi_id"], r["numerator"], r["denominator"], r["format"], r["domain"],
            limits["min"] if limits else None, limits["max"] if limits else None,
            r["display_name"], tuple(r["aliases"] or ()), tuple(r["source_fields"] or ()),
            bool(r["reviewed"]), r["description"] or "",
        )
    return found


def within_period(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows whose date lies in the period, both days included; open without a bound."""
    if start is not None:
        df = df.where(F.col(column) >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col(column) < F.date_add(F.to_date(F.lit(end)), 1))
    return df


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def column_totals(facts: DataFrame, columns: Iterable[str], group_by: Sequence[Column] = (),
                  exact: bool = True) -> tuple[DataFrame, dict[str, Column]]:
    """Totals of all distinct columns in one aggregate, and where to find each."""
    names = list(dict.fromkeys(columns))
    where = {c: F.col(f"_total{i}") for i, c in enumerate(names)}
    sums = [
        total(F.col(c), facts.schema[c].dataType, exact).alias(f"_total{i}")
        for i, c in enumerate(names)
    ]
    return facts.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_rows"), *sums), where


def evaluate(rows: DataFrame, headers: list[str], numeric: list[str],
             validate_totals: bool = False) -> DataFrame:
    """Value, KPI flags and report flags of KPI rows that carry their totals.

    A row has kpi_id, in_catalog, is_total, numerator, denominator (column names),
    numerator_total, denominator_total, low and high. The flag texts are fixed values. Totals are not
    range-checked unless asked. A mapped column that is there but holds no numbers is flagged
    as well. Rows that say themselves whether their columns are there (has_numerator,
    has_denominator) are not judged by ``headers``.
    """
    numerator, denominator = F.col("numerator"), F.col("denominator")
    is_total, in_catalog, value = F.col("is_total"), F.col("in_catalog"), F.col("_value")

    def named(column: Column) -> Column:
        return F.concat(F.lit("'"), F.coalesce(column, F.lit("None")), F.lit("'"))

    def absent(column: Column) -> Column:
        return ~F.coalesce((column != "") & column.isin(headers), F.lit(False))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    own = {"has_numerator", "has_denominator"} <= set(rows.columns)
    no_numerator = ~F.col("has_numerator") if own else absent(numerator)
    no_denominator = ~F.col("has_denominator") if own else absent(denominator)
    gap = (
        F.when(~in_catalog, "unknown")
        .when(no_numerator, "numerator")
        .when(~is_total & no_denominator, "denominator")
        .when(~numerator.isin(numeric), "numerator type")
        .when(~is_total & ~denominator.isin(numeric), "denominator type")
        .when(~is_total & (F.col("denominator_total") == 0), "zero")
    )
    computed = F.when(F.col("_gap").isNull(), F.when(is_total, F.col("numerator_total")).otherwise(
        ratio(F.col("numerator_total"), F.col("denominator_total"))))

    def told(in_report: bool) -> Column:
        ending = " not found" if in_report else " missing"
        of_total = " not found in file" if in_report else " missing"
        zero = (text("denominator sums to zero — check column ", named(denominator))
                if in_report else F.lit("denominator is zero"))
        kind = F.col("_gap")
        return (
            F.when(kind.isNull(), None)
            .when((kind == "numerator") & is_total, text("column ", named(numerator), of_total))
            .when(kind == "numerator", text("numerator column ", named(numerator), ending))
            .when(kind == "denominator", text("denominator column ", named(denominator), ending))
            .when(kind == "numerator type", text("column ", named(numerator), " is not numeric"))
            .when(kind == "denominator type", text("column ", named(denominator), " is not numeric"))
            .when(kind == "zero", zero)
            .when(F.lit(in_report), "not found in catalog")
        )

    checked = F.lit(True) if validate_totals else ~is_total
    shown = F.format_string("%.4f", value)
    below = F.when(checked & (value < F.col("low")),
                   text("value ", shown, " below expected min ", plain_number(F.col("low"))))
    above = F.when(checked & (value > F.col("high")),
                   text("value ", shown, " above expected max ", plain_number(F.col("high"))))
    outside = F.array_compact(F.array(below, above))
    with_texts = rows.withColumn("_gap", gap).withColumn("_value", computed).withColumns({
        "_problem": told(in_report=False), "_report_problem": told(in_report=True),
        "_outside": outside,
    })
    flagged = with_texts.withColumns({
        "value": round_kpi(value),
        "flags": F.concat(F.array_compact(F.array("_problem")), F.col("_outside")),
        "report_flags": F.transform(
            F.concat(F.array_compact(F.array("_report_problem")), F.col("_outside")),
            lambda f: text(F.col("kpi_id"), ": ", f)),
    })
    return flagged.drop("_gap", "_value", "_problem", "_report_problem", "_outside", "is_total",
                        "numerator", "denominator", "numerator_total", "denominator_total",
                        "low", "high", "has_numerator", "has_denominator")


def compute_kpis(facts: DataFrame, kpi_list: Sequence[str], catalog: dict[str, KpiDef],
                 mapping: dict[str, ColumnMapping], group_by: Sequence[Column | str] = (),
                 exact: bool = True, validate_totals: bool = False) -> DataFrame:
    """All KPIs of one report in a single aggregate over the mapped columns.

    Every distinct mapped column is summed once, whichever KPIs use it, then each group row is
    turned into one row per KPI without a join. With ``group_by`` this is the grouped form
    behind trends and breakdowns; a ratio stays a ratio of sums within each group.
    """
    groups = [F.col(g) if isinstance(g, str) else g for g in group_by]
    headers, numeric = facts.columns, numeric_columns(facts)
    maps = [mapping.get(k, ColumnMapping()) for k in kpi_list]
    needed = [c for m in maps for c in (m.numerator, m.denominator_column) if c in numeric]
    totals, where = column_totals(facts, needed, groups, exact)
    return kpis_from_totals(totals, where, kpi_list, catalog, mapping, headers, numeric,
                            validate_totals)


def kpis_from_totals(totals: DataFrame, where: dict[str, Column], kpi_list: Sequence[str],
                     catalog: dict[str, KpiDef], mapping: dict[str, ColumnMapping],
                     headers: list[str], numeric: list[str],
                     validate_totals: bool = False) -> DataFrame:
    """One row per KPI for each row of totals; ``where`` says which column holds which total."""
    maps = [mapping.get(k, ColumnMapping()) for k in kpi_list]
    nothing = F.lit(None).cast("double")
    rows = []
    for position, (kpi_id, m) in enumerate(zip(kpi_list, maps)):
        kpi = catalog.get(kpi_id)
        is_total = kpi is not None and kpi.denominator == NO_DENOMINATOR
        rows.append(F.struct(
            F.lit(position).alias("position"), F.lit(kpi_id).alias("kpi_id"),
            F.lit(kpi is not None).alias("in_catalog"), F.lit(is_total).alias("is_total"),
            F.lit(m.numerator).cast("string").alias("numerator"),
            F.lit(m.denominator_column).cast("string").alias("denominator"),
            where.get(m.numerator, nothing).alias("numerator_total"),
            where.get(m.denominator_column, nothing).alias("denominator_total"),
            F.lit(kpi.min if kpi else None).cast("double").alias("low"),
            F.lit(kpi.max if kpi else None).cast("double").alias("high"),
        ))
    used = {"_rows", *(f"_total{i}" for i in range(len(where)))}
    kept = [c for c in totals.columns if c not in used]
    return evaluate(totals.select(*kept, F.inline(F.array(*rows))), headers, numeric,
                    validate_totals)


def mapped_columns(mapping: DataFrame, headers: Sequence[str]) -> list[str]:
    """Distinct mapped columns the table has; never more than the table is wide."""
    names = F.explode(F.array(numerator_of(), F.col("denominator_column")))
    rows = mapping.select(names.alias("c")).where(F.col("c").isin(list(headers))).distinct()
    return sorted(r["c"] for r in rows.collect())


def numerator_of() -> Column:
    return F.coalesce(F.nullif(F.col("numerator_column"), F.lit("")), F.col("raw_column"))


def sum_folds(facts: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, dict[str, Column]]:
    """Per column the aggregates whose results add up again over any grouping of rows, by prefix and part."""
    folds: dict[str, dict[str, Column]] = {}
    for i, c in enumerate(columns):
        dtype = facts.schema[c].dataType
        value = present(F.col(c), dtype)
        if isinstance(dtype, T.BooleanType):
            value, dtype = value.cast("int"), T.IntegerType()
        plain = isinstance(dtype, T.DecimalType) or not exact
        folds[f"_p{i}"] = {"sum": F.sum(value)} if plain else exact_parts(value, dtype)
    return folds


def folded_value(prefix: str, parts: dict[str, Column]) -> Column:
    """The total behind the parts of one column, 0.0 when nothing is there."""
    if "sum" in parts:
        return F.coalesce(F.col(f"{prefix}_sum").cast("double"), F.lit(0.0))
    return exact_value({n: F.col(f"{prefix}_{n}") for n in parts})


def period_totals(facts: DataFrame, columns: Sequence[str], periods: DataFrame, key: str, facts_key: str,
                  date_column: str, exact: bool = True) -> DataFrame:
    """(key, _sums): totals of each request's facts within its own days, in the order of ``columns``.

    Facts become one row of sums per (facts_key, day) in each task before anything is shuffled or joined; periods meet
    days, never facts, so requests whose periods overlap share what was summed. The parts of a sum add up exactly.
    """
    folds = sum_folds(facts, columns, exact)
    names = [f"{p}_{n}" for p, parts in folds.items() for n in parts]
    daily = facts.groupBy(facts_key, F.to_date(date_column).alias("_day")).agg(
        F.count(F.lit(1)).alias("_rows"), *[c.alias(f"{p}_{n}") for p, parts in folds.items() for n, c in parts.items()])
    bounds = periods.select(*dict.fromkeys((key, facts_key)), "period_start", "period_end")
    day = F.col("_day")
    inside = (F.coalesce(day >= F.to_date("period_start"), F.col("period_start").isNull())
              & F.coalesce(day <= F.to_date("period_end"), F.col("period_end").isNull()))
    held = daily.join(bounds, facts_key, "left" if key == facts_key else "inner").where(inside)
    merged = held.groupBy(key).agg(*[F.sum(n).alias(n) for n in names])

    values = [folded_value(p, parts) for p, parts in folds.items()]
    return merged.select(key, F.array(*values).cast("array<double>").alias("_sums"))


def compute_requests(facts: DataFrame, requested: DataFrame, catalog: DataFrame,
                     mapping: DataFrame, key: str = "request_id", exact: bool = True,
                     validate_totals: bool = False, file_headers: DataFrame | None = None,
                     periods: DataFrame | None = None, date_column: str | None = None,
                     facts_key: str | None = None) -> DataFrame:
    """KPIs of many requests over one keyed fact table in one job.

    ``requested`` is (key, position, kpi_id) and ``mapping`` one row per (key, kpi_id). The facts
    are summed per key first, so only one row per key is shuffled from each task, and the KPI
    rows meet sums instead of facts. A key without facts has totals of zero, like an empty file.

    ``file_headers`` (key, header) says which columns each request's own file has: one it lacks is
    null in the shared table and is flagged instead of summing to zero. ``periods`` (key,
    period_start, period_end) keeps each request's facts of its own days by ``date_column``, both
    days included and open without a bound. Requests that share facts name them there by ``facts_key``,
    the facts' own key.
    """
    headers, numeric = facts.columns, numeric_columns(facts)
    used = [c for c in mapped_columns(mapping, headers) if c in numeric]
    if periods is not None:
        sums = period_totals(facts, used, periods, key, facts_key or key, date_column, exact)
    else:
        totals, where = column_totals(facts, used, [F.col(key)], exact)
        sums = totals.select(key, F.array(*where.values()).cast("array<double>").alias("_sums"))
    known = catalog.select(
        "kpi_id", F.lit(True).alias("_known"), F.col("denominator").alias("_den"),
        F.col("expected_range.min").alias("_low"), F.col("expected_range.max").alias("_high"),
    )
    mapped = mapping.select(
        key, "kpi_id", numerator_of().alias("_num_col"),
        F.col("denominator_column").alias("_den_col"),
    )
    plan = (
        requested.join(known, "kpi_id", "left")
        .join(mapped, [key, "kpi_id"], "left").join(sums, key, "left")
    )

    def summed(column: str) -> Column:
        place = F.array_position(F.array(*[F.lit(c) for c in used]).cast("array<string>"),
                                 F.col(column))
        return F.when(F.col(column).isin(used),
                      F.coalesce(F.get("_sums", (place - 1).cast("int")), F.lit(0.0)))

    rows = plan.select(
        key, "position", "kpi_id", F.coalesce("_known", F.lit(False)).alias("in_catalog"),
        F.coalesce(F.col("_den") == NO_DENOMINATOR, F.lit(False)).alias("is_total"),
        F.col("_num_col").alias("numerator"), F.col("_den_col").alias("denominator"),
        summed("_num_col").alias("numerator_total"), summed("_den_col").alias("denominator_total"),
        F.col("_low").alias("low"), F.col("_high").alias("high"),
    )
    if file_headers is not None:
        for side in ("numerator", "denominator"):
            held = file_headers.select(key, F.col("header").alias(side), F.lit(True).alias(f"has_{side}")).distinct()
            rows = rows.join(held, [key, side], "left").withColumn(
                f"has_{side}", F.coalesce(F.col(f"has_{side}") & F.col(side).isin(headers), F.lit(False)))
    return evaluate(rows, headers, numeric, validate_totals)


def values_only(results: DataFrame) -> DataFrame:
    """Computed rows; a KPI outside the catalog has report flags but no value row."""
    return results.where("in_catalog")


def report_flags(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Report flags in KPI order and their count; one array per report, as long as its KPI list."""
    gathered = F.sort_array(F.collect_list(F.struct("position", "report_flags")))
    return (
        results.groupBy(*keys).agg(gathered.alias("_flags"))
        .withColumn("data_quality_flags",
                    F.flatten(F.transform("_flags", lambda f: f["report_flags"])))
        .withColumn("flag_count", F.size("data_quality_flags"))
        .drop("_flags")
    )


def unknown_kpis(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Report flag of every requested KPI outside the catalog."""
    return (
        requested.join(catalog.select("kpi_id"), "kpi_id", "left_anti")
        .withColumn("flag", F.concat("kpi_id", F.lit(": not found in catalog")))
    )


def kpi_trend(facts: DataFrame, date_column: str, granularity: str, kpi_list: Sequence[str],
              catalog: dict[str, KpiDef], mapping: dict[str, ColumnMapping],
              dimensions: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """KPIs per period, optionally per dimension value as well."""
    groups = [grain(F.col(date_column), granularity).alias("period"), *dimensions]
    return compute_kpis(facts, kpi_list, catalog, mapping, groups, exact)


def kpi_cube(facts: DataFrame, date_column: str, kpi_list: Sequence[str], catalog: dict[str, KpiDef],
             mapping: dict[str, ColumnMapping], dimensions: Sequence[str] = (),
             granularities: Sequence[str] = tuple(GRAINS), exact: bool = True) -> DataFrame:
    """KPIs per period of every grain and every subset of the dimensions, from one table of sums.

    Facts become one row of sums per (day, dimension values) in each task; those alone are shuffled, and every coarser
    level adds them up by grouping sets. A ratio stays a ratio of sums at each level. A row has ``granularity``,
    ``period``, the dimensions (null where summed over), ``level`` (the kept ones, comma-joined), then the KPI's
    columns. Facts without a date have a null period; an empty table has no rows.
    """
    headers, numeric = facts.columns, numeric_columns(facts)
    maps = [mapping.get(k, ColumnMapping()) for k in kpi_list]
    needed = list(dict.fromkeys(c for m in maps for c in (m.numerator, m.denominator_column) if c in numeric))
    folds = sum_folds(facts, needed, exact)
    names = [f"{p}_{n}" for p, parts in folds.items() for n in parts]
    days = facts.groupBy(grain(F.col(date_column), "daily").alias("_day"), *dimensions).agg(
        F.count(F.lit(1)).alias("_rows"), *[c.alias(f"{p}_{n}") for p, parts in folds.items() for n, c in parts.items()])
    starts = {g: f"_start_{g}" for g in granularities}
    dated = days.withColumns({c: grain(F.col("_day"), g) for g, c in starts.items()})
    kept = [d for n in range(len(dimensions) + 1) for d in combinations(dimensions, n)]
    sets = [[F.col(c) for c in (start, *subset)] for start in starts.values() for subset in kept]
    columns = [*starts.values(), *dimensions]
    summed = dated.groupingSets(sets, *columns).agg(
        *[F.grouping(c).alias(f"_over_{i}") for i, c in enumerate(columns)],
        F.sum("_rows").alias("_rows"), *[F.sum(n).alias(n) for n in names])
    is_kept = {c: F.col(f"_over_{i}") == 0 for i, c in enumerate(columns)}
    totals = summed.select(
        F.coalesce(*[F.when(is_kept[c], g) for g, c in starts.items()]).alias("granularity"),
        F.coalesce(*starts.values()).alias("period"), *dimensions,
        F.array_join(F.array_compact(F.array(
            *[F.when(is_kept[d], d) for d in dimensions]).cast("array<string>")), ",").alias("level"),
        "_rows", *[folded_value(p, parts).alias(f"_total{i}") for i, (p, parts) in enumerate(folds.items())])
    where = {c: F.col(f"_total{i}") for i, c in enumerate(needed)}
    return kpis_from_totals(totals, where, kpi_list, catalog, mapping, headers, numeric)


def period_delta(trend: DataFrame, dimensions: Sequence[str] = (),
                 threshold: float = 0.5, granularity: str | None = None) -> DataFrame:
    """Change against the previous period; flagged when it exceeds half of it either way.

    With ``granularity`` the previous period is the one just before by the calendar: after a period
    without facts there is nothing to compare with. Without it, it is the row before. The window runs over aggregated rows: one per period of a KPI and
    dimension value.
    """
    series = W.partitionBy("kpi_id", *dimensions).orderBy("period")
    previous = F.lag("value").over(series)
    if granularity is not None:
        day_before = F.col("period") - F.expr("INTERVAL 1 DAY")
        previous = F.when(F.lag("period").over(series) == grain(day_before, granularity), previous)
    return (
        trend.withColumn("previous", previous)
        .withColumn("delta", F.when(F.col("previous") != 0,
                                    F.try_divide(F.col("value") - F.col("previous"),
                                                 F.col("previous"))))
        .withColumn("large_change", F.coalesce(F.abs("delta") > threshold, F.lit(False)))
    )
