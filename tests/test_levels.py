"""KPI cube, latest state as a stream, and the profile merged from files' parts."""

from datetime import datetime

from pyspark.sql import functions as F

from kpiloom.operators import governance, kpi
from kpiloom.operators.kpi import ColumnMapping, KpiDef
from kpiloom.streaming import profile, state

CATALOG = {"units": KpiDef("units", "n", "_none_"), "rate": KpiDef("rate", "n", "d")}
MAPPING = {"units": ColumnMapping(raw_column="n"), "rate": ColumnMapping(None, "n", "d")}
FACTS = "at timestamp, kind string, place string, n bigint, d double"


def cube_of(spark, rows):
    facts = spark.createDataFrame(rows, FACTS)
    return kpi.kpi_cube(facts, "at", list(CATALOG), CATALOG, MAPPING, ["kind", "place"])


def test_cube_tells_null_values_from_levels(spark):
    rows = [(datetime(2024, 1, 1, 5), "a", "x", 1, 2.0), (datetime(2024, 1, 3), None, "x", 3, 2.0),
            (datetime(2024, 2, 1), "a", None, 5, 0.0), (None, "a", "x", 7, 1.0), (None, "a", "x", None, float("nan"))]
    got = {(r["granularity"], r["period"] and str(r["period"])[:10], r["level"], r["kind"], r["place"], r["kpi_id"]): r["value"]
           for r in cube_of(spark, rows).collect()}
    assert got["monthly", "2024-01-01", "", None, None, "units"] == 4
    assert got["monthly", "2024-01-01", "kind", None, None, "units"] == 3
    assert got["weekly", "2024-01-01", "place", None, "x", "rate"] == 1.0
    assert got["daily", "2024-02-01", "kind,place", "a", None, "rate"] is None
    assert got["daily", None, "", None, None, "units"] == 7 and got["weekly", None, "kind", "a", None, "rate"] == 7.0


def test_cube_equals_each_trend(spark):
    rows = [(datetime(2024, 1 + i % 3, 1 + i % 28), f"k{i % 2}", f"p{i % 3}", i, 0.1 * i) for i in range(200)]
    cube = cube_of(spark, rows)
    facts = spark.createDataFrame(rows, FACTS)
    for granularity in ("daily", "weekly", "monthly"):
        for kept in ([], ["kind"], ["kind", "place"]):
            shown = ["period", *kept, "kpi_id", "value"]
            trend = kpi.kpi_trend(facts, "at", granularity, list(CATALOG), CATALOG, MAPPING, kept)
            level = cube.where((F.col("granularity") == granularity) & (F.col("level") == ",".join(kept)))
            assert sorted(level.select(shown).collect()) == sorted(trend.select(shown).collect())


def test_cube_of_nothing_and_without_dimensions(spark):
    assert cube_of(spark, []).collect() == []
    facts = spark.createDataFrame([(datetime(2024, 1, 1), "a", "x", 1, 2.0)], FACTS)
    plain = kpi.kpi_cube(facts, "at", ["units"], CATALOG, MAPPING, granularities=["daily"])
    assert [(r["level"], r["value"]) for r in plain.collect()] == [("", 1.0)]


def test_state_takes_late_and_repeated_updates(spark, tmp_path):
    schema = "request_id string, seq bigint, changes map<string,string>, updated_at timestamp"
    late = [("a", 5, {"status": "done"}, datetime(2024, 1, 5)), ("b", 6, {"status": None}, datetime(2024, 1, 6))]
    early = [("a", 1, {"status": "new", "file": "f1"}, datetime(2024, 1, 1)), ("b", 2, {"status": "new"}, datetime(2024, 1, 2)),
             ("c", 3, {}, datetime(2024, 1, 3)), late[0]]
    files, fields = str(tmp_path / "files"), ["status", "file"]
    for rows in (late, early, []):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(files)
        arriving = spark.readStream.schema(schema).parquet(files)
        state.follow(arriving, fields, str(tmp_path / "state"), str(tmp_path / "mark"))
    got = sorted(state.current_state(spark, str(tmp_path / "state"), fields).collect())
    batch = governance.latest_state(spark.createDataFrame(late + early, schema), fields)
    assert got == sorted(batch.collect())
    assert [(r["request_id"], r["status"], r["file"]) for r in got] == [("a", "done", "f1"), ("b", None, None), ("c", None, None)]


def test_profile_parts_merge(spark):
    rows = [(f"file{i % 3}", i, float("nan") if i % 4 == 0 else i % 10 + 0.5, "x" * 500 if i % 2 else None, i % 5) for i in range(3_000)]
    df = spark.createDataFrame(rows, "_file string, id bigint, v double, text string, _rows int")
    parts = profile.profile_parts(df, ["_file"])
    assert parts.count() == 12
    got = {r["column"]: r for r in profile.merged_profile(parts).collect()}
    for name, distinct, missing in (("id", 3_000, 0), ("v", 10, 750), ("text", 1, 1_500), ("_rows", 5, 0)):
        row = got[name]
        assert (row["total"], row["missing_count"]) == (3_000, missing)
        assert abs(row["unique_estimate"] - distinct) <= distinct * profile.DISTINCT_ERROR
    assert profile.profile_parts(df.limit(0), ["_file"]).count() == 0
