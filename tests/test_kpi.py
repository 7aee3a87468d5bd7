import math

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import kpi, recipe
from kpiloom.operators.kpi import ColumnMapping, KpiDef

CATALOG = {k.kpi_id: k for k in [
    KpiDef("total", "a"), KpiDef("rate", "a", "b", min=0, max=1), KpiDef("floor", "a", "b", min=5),
    KpiDef("text_total", "t"),
]}
BOTH = ColumnMapping(None, "a", "b")
MAPPING = {"total": ColumnMapping("a"), "rate": BOTH, "floor": BOTH, "text_total": ColumnMapping("t")}


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("x", 1.0, 2, "p"), ("x", None, 3, "q"), ("y", float("nan"), 5, "r"), ("y", 6.0, None, "s")]
    return spark.createDataFrame(rows, "g string, a double, b int, t string")


def by_id(df):
    return {r["kpi_id"]: r for r in df.collect()}


def test_totals_and_ratios(facts):
    got = by_id(kpi.compute_kpis(facts, ["total", "rate", "floor"], CATALOG, MAPPING))
    assert got["total"]["value"] == 7.0 and got["total"]["flags"] == []
    assert got["rate"]["value"] == 0.7 and got["rate"]["flags"] == []
    assert got["floor"]["flags"] == ["value 0.7000 below expected min 5"]
    assert got["floor"]["report_flags"] == ["floor: value 0.7000 below expected min 5"]


def test_totals_are_not_range_checked_unless_asked(facts):
    catalog = {"total": KpiDef("total", "a", max=1)}
    assert by_id(kpi.compute_kpis(facts, ["total"], catalog, MAPPING))["total"]["flags"] == []
    flagged = kpi.compute_kpis(facts, ["total"], catalog, MAPPING, validate_totals=True)
    assert by_id(flagged)["total"]["flags"] == ["value 7.0000 above expected max 1"]


def test_range_looks_at_the_unrounded_value(spark):
    facts = spark.createDataFrame([(1.00001, 1.0)], "a double, b double")
    got = by_id(kpi.compute_kpis(facts, ["rate"], CATALOG, MAPPING))["rate"]
    assert got["value"] == 1.0 and got["flags"] == ["value 1.0000 above expected max 1"]


def test_missing_columns_and_zero_denominator(facts):
    mapping = {"total": ColumnMapping("gone"), "rate": ColumnMapping("a"),
               "floor": ColumnMapping(None, "a", "zero"), "text_total": ColumnMapping("t")}
    got = by_id(kpi.compute_kpis(facts.withColumn("zero", F.lit(0)),
                                 ["total", "rate", "floor", "text_total", "other"], CATALOG, mapping))
    assert got["total"]["flags"] == ["column 'gone' missing"]
    assert got["total"]["report_flags"] == ["total: column 'gone' not found in file"]
    assert got["rate"]["flags"] == ["denominator column 'None' missing"]
    assert got["rate"]["report_flags"] == ["rate: denominator column 'None' not found"]
    assert got["floor"]["flags"] == ["denominator is zero"]
    assert got["floor"]["report_flags"] == ["floor: denominator sums to zero — check column 'zero'"]
    assert got["text_total"]["flags"] == ["column 't' is not numeric"]
    assert not got["other"]["in_catalog"] and got["other"]["flags"] == []
    assert got["other"]["report_flags"] == ["other: not found in catalog"]


def test_flag_roll_up_keeps_kpi_order(facts):
    results = kpi.compute_kpis(facts, ["other", "floor", "rate"], CATALOG, MAPPING)
    row = kpi.report_flags(results).first()
    assert row["data_quality_flags"] == [
        "other: not found in catalog", "floor: value 0.7000 below expected min 5"]
    assert row["flag_count"] == 2


def test_all_null_sum_is_zero(spark):
    facts = spark.createDataFrame([(None, None)], "a double, b double")
    got = by_id(kpi.compute_kpis(facts, ["total", "rate"], CATALOG, MAPPING))
    assert got["total"]["value"] == 0.0 and got["rate"]["flags"] == ["denominator is zero"]


def test_groups_recombine_to_the_total(facts):
    grouped = kpi.compute_kpis(facts, ["total"], CATALOG, MAPPING, ["g"]).collect()
    assert sum(r["value"] for r in grouped) == 7.0


def test_exact_sums_do_not_depend_on_partitions(spark):
    values = [(float(f"{i % 1000}.{i % 100:02d}") * (-1) ** i,) for i in range(20000)]
    df = spark.createDataFrame(values, "a double")
    results = {kpi.compute_kpis(df.repartition(n), ["total"], CATALOG, MAPPING).first()["value"]
               for n in (1, 3, 7)}
    cents = sum(round(v[0] * 100) for v in values)
    assert results == {cents / 100}


def test_exact_sums_of_negative_large_and_endless_values(spark):
    def summed(*values):
        df = spark.createDataFrame([(v,) for v in values], "a double")
        return kpi.compute_kpis(df, ["total"], CATALOG, MAPPING).first()["value"]

    assert summed(-1.25, -0.5, 3.0) == 1.25
    assert summed(1e15, 2e18, 0.25) == 1e15 + 2e18 + 0.25
    assert summed(999999999999.75, -0.75) == 999999999999.0
    assert summed(float("inf"), 1.0) == float("inf")


def test_period_is_inclusive_by_day(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 23:59:59', "
                   "timestamp_ntz'2024-02-01 00:00:00')) AS d")
    assert kpi.within_period(df, "d", "2024-01-01", "2024-01-31").count() == 2
    assert kpi.within_period(df, "d", None, None).count() == 3


def test_period_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.sql("SELECT timestamp_ntz'2024-01-01 10:00:00' AS d, 1.5 AS a, 'x' AS unused").write.parquet(path)
    df = kpi.within_period(spark.read.parquet(path), "d", "2024-01-01", "2024-01-31")
    plan = kpi.compute_kpis(df, ["total"], CATALOG, MAPPING)._jdf.queryExecution().toString()
    schema = plan.rsplit("ReadSchema: ", 1)[1]
    assert "GreaterThanOrEqual(d," in plan and "unused" not in schema


def test_many_requests_equal_single_reports(spark, facts):
    keyed = facts.withColumnRenamed("g", "request_id")
    requested = spark.createDataFrame(
        [(r, i, k) for r in ("x", "y", "z") for i, k in enumerate(["total", "rate", "other"])],
        "request_id string, position int, kpi_id string")
    catalog = spark.createDataFrame(
        [(k.kpi_id, k.denominator, tuple(None if v is None else float(v) for v in (k.min, k.max)))
         for k in CATALOG.values()],
        "kpi_id string, denominator string, expected_range struct<min: double, max: double>")
    mapping = spark.createDataFrame(
        [(r, k, None, "a", "b") for r in ("x", "y", "z") for k in ("total", "rate")],
        "request_id string, kpi_id string, raw_column string, numerator_column string, denominator_column string")
    got = {(r["request_id"], r["kpi_id"]): r for r in kpi.compute_requests(
        keyed, requested, catalog, mapping).collect()}
    for key in ("x", "y"):
        single = by_id(kpi.compute_kpis(facts.where(F.col("g") == key), ["total", "rate"], CATALOG, MAPPING))
        for k in ("total", "rate"):
            assert got[key, k]["value"] == single[k]["value"] and got[key, k]["flags"] == single[k]["flags"]
    assert got["z", "total"]["value"] == 0.0 and got["z", "rate"]["flags"] == ["denominator is zero"]
    assert not got["x", "other"]["in_catalog"]


def test_formulas(facts):
    rows = {r["name"]: r for r in recipe.formula_kpis(facts, [
        ("r", "r = a / b"), ("s", "(a + 1) * -2"), ("z", "a / (b - 10)"), ("m", "nope + 1"), ("t", "t * 2"),
    ]).collect()}
    assert rows["r"]["value"] == 0.7 and rows["s"]["value"] == -16.0
    assert rows["z"]["value"] is None and rows["z"]["flags"] == ["denominator is zero"]
    assert rows["m"]["flags"] == ["column 'nope' missing"]
    assert rows["t"]["flags"] == ["column 't' is not numeric"]


@pytest.mark.parametrize("formula", ["__import__('os')", "a ** 2", "a; b", "a if b else a", "a.b"])
def test_formulas_are_plain_arithmetic(facts, formula):
    with pytest.raises((ValueError, SyntaxError, KeyError)):
        recipe.formula_kpis(facts, [("x", formula)])


def test_period_delta(spark):
    trend = spark.createDataFrame(
        [("k", 1, 10.0), ("k", 2, 16.0), ("k", 3, 0.0), ("k", 4, 5.0)], "kpi_id string, period int, value double")
    rows = {r["period"]: r for r in kpi.period_delta(trend).collect()}
    assert rows[2]["delta"] == pytest.approx(0.6) and rows[2]["large_change"]
    assert rows[3]["delta"] == -1.0 and rows[4]["delta"] is None and not rows[4]["large_change"]


def test_period_delta_knows_the_calendar(spark):
    trend = spark.sql("SELECT 'k' AS kpi_id, period, value FROM VALUES (timestamp_ntz'2024-01-01', 1.0D), "
                      "(timestamp_ntz'2024-02-01', 2.0D), (timestamp_ntz'2024-04-01', 4.0D) AS t(period, value)")
    rows = kpi.period_delta(trend, granularity="monthly").orderBy("period").collect()
    assert [r["previous"] for r in rows] == [None, 1.0, None]


def test_recipe_filters_must_be_offered(facts):
    assert recipe.apply_filters(facts, ["g"], {"g": ["x"]}).count() == 2
    with pytest.raises(ValueError):
        recipe.apply_filters(facts, ["g"], {"a": [1]})


def test_catalog_file_to_kpis(spark, facts, tmp_path):
    import json

    from kpiloom.sources.catalog_files import read_catalog, replace_catalog, stored_catalog

    (tmp_path / "kpis.json").write_text(json.dumps([
        {"kpi_id": "rate", "display_name": "Rate", "numerator": "a", "denominator": "b", "format": "percentage",
         "domain": "ops", "expected_range": {"min": 0, "max": 0.5}, "aliases": ["r"]},
        {"kpi_id": "total", "display_name": "Total", "numerator": "a", "denominator": "_none_", "format": "integer",
         "domain": "ops"}], indent=1))
    for _ in range(2):
        replace_catalog(read_catalog(spark, str(tmp_path / "kpis.json")), str(tmp_path / "catalog"))
    stored = stored_catalog(spark, str(tmp_path / "catalog"))
    assert stored.count() == 2
    known = kpi.definitions(stored, ["rate", "total", "nope"])
    assert set(known) == {"rate", "total"} and known["rate"].aliases == ("r",) and known["total"].min is None
    got = by_id(kpi.compute_kpis(facts, ["rate", "total"], known, MAPPING))
    assert got["rate"]["flags"] == ["value 0.7000 above expected max 0.5"] and got["total"]["value"] == 7.0


def test_trend_periods_are_wall_clock(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-03 05:00:00' AS d, 2.0D AS a UNION ALL SELECT timestamp_ntz'2024-01-09 23:00:00', 3.0D")
    trend = kpi.kpi_trend(df, "d", "weekly", ["total"], CATALOG, MAPPING)
    assert dict(trend.dtypes)["period"] == "timestamp_ntz"
    assert {str(r["period"]): r["value"] for r in trend.collect()} == {"2024-01-01 00:00:00": 2.0, "2024-01-08 00:00:00": 3.0}


def test_values_below_a_millionth_and_above_a_trillion_keep_their_digits(spark):
    rows = spark.createDataFrame([(1e-7, 2e-7, 3e15)] * 5, "num double, den double, huge double")
    catalog = {"r": kpi.KpiDef("r", "num", "den"), "h": kpi.KpiDef("h", "huge", "_none_")}
    mapping = {"r": kpi.ColumnMapping(None, "num", "den"), "h": kpi.ColumnMapping(raw_column="huge")}
    got = {r["kpi_id"]: (r["value"], r["flags"]) for r in kpi.compute_kpis(rows, ["r", "h"], catalog, mapping).collect()}
    assert got == {"r": (0.5, []), "h": (1.5e16, [])}


def test_overlapping_periods_share_daily_sums(spark):
    """Requests over one client's facts with overlapping, open and empty periods; no fact is joined."""
    rows = [(f"c{i % 2}", f"2024-01-{1 + i % 28:02d}", 10.0 ** (i % 20) + 0.1 * i, i % 3 == 0) for i in range(400)] + [("c0", None, 5.0, True)]
    facts = spark.createDataFrame(rows, "client string, day string, a double, b boolean")
    periods = [("r1", "c0", "2024-01-03", "2024-01-20"), ("r2", "c0", "2024-01-10", None), ("r3", "c0", None, None),
               ("r4", "c1", None, "2024-01-02"), ("r5", "c1", "2030-01-01", "2030-01-02"), ("r6", "c9", None, None)]
    frame = spark.createDataFrame(periods, "request_id string, client string, period_start string, period_end string")
    sums = kpi.period_totals(facts, ["a", "b"], frame, "request_id", "client", "day")
    got = {r["request_id"]: r["_sums"] for r in sums.collect()}
    for request, client, start, end in periods:
        held = [(a, b) for c, d, a, b in rows if c == client and (start is None or (d and d >= start)) and (end is None or (d and d <= end))]
        if not held:
            assert request not in got
            continue
        assert got[request][1] == sum(b for _, b in held)
        assert abs(got[request][0] - math.fsum(a for a, _ in held)) <= 1e-12 * got[request][0]
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    join, aggregates = plan.index("Join "), [i for i in range(len(plan)) if plan.startswith("Aggregate [client", i)]
    assert aggregates and aggregates[0] > join  # facts are aggregated below the join
