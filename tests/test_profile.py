import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiloom.operators import profile


def profiled(df, order=("id",), **kw):
    return {r["name"]: r for r in profile.profile_columns(df, list(order) if order else None, **kw).collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for i in range(300):
        rows.append((i, float(i) if i % 4 else None, i % 3 if i % 2 else None, i % 2 == 0, f"text number {i}",
                     f"2024-01-{i % 28 + 1:02d}", f"2024-02-{i % 28 + 1:02d}" if i % 3 else "hello",
                     f"2024-02-{i % 28 + 1:02d}" if i % 3 else "hello", dt.datetime(2024, 1, 1), None))
    return spark.createDataFrame(rows, (
        "id bigint, amount double, small int, flag boolean, note string, shipped string, date string, "
        "order_date string, at timestamp_ntz, nothing double"))


def test_types_roles_and_counts(mixed):
    got = profiled(mixed)
    assert {n: (r["detected_type"], r["suggested_role"]) for n, r in got.items()} == {
        "id": ("numeric", "measure"), "amount": ("numeric", "measure"), "small": ("categorical", "dimension"),
        "flag": ("categorical", "dimension"), "note": ("text", "dimension"), "shipped": ("date", "date"),
        "date": ("date", "date"), "order_date": ("categorical", "dimension"), "at": ("date", "date"),
        "nothing": ("categorical", "dimension")}
    assert got["amount"]["missing_count"] == 75 and got["amount"]["missing_pct"] == 25.0
    assert got["amount"]["unique_count"] == 225 and got["amount"]["sample_values"][:2] == ["1.0", "2.0"]
    assert got["small"]["raw_dtype"] == "float64" and got["id"]["raw_dtype"] == "int64"
    assert got["nothing"]["sample_values"] == [] and got["nothing"]["unique_count"] == 0


def test_approximate_counts_agree_on_small_tables(mixed):
    exact, rough = profiled(mixed), profiled(mixed, exact=False)
    for name, row in exact.items():
        assert rough[name]["detected_type"] == row["detected_type"]
        assert rough[name]["missing_count"] == row["missing_count"]
        assert abs(rough[name]["unique_count"] - row["unique_count"]) <= max(2, 0.05 * row["unique_count"])


def test_empty_table(spark):
    got = profiled(spark.createDataFrame([], "id int, t string"))
    assert got["t"]["missing_pct"] == 0.0 and got["t"]["detected_type"] == "categorical"


def test_nan_is_missing_and_signed_zero_is_one_value(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.0), (3, -0.0)], "id int, v double")
    row = profiled(df)["v"]
    assert row["missing_count"] == 1 and row["unique_count"] == 1 and row["sample_values"] == ["0.0", "0.0"]


def test_date_words_and_formats(spark):
    def kind(name, values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, `{name}` string")
        return profiled(df)[name]["detected_type"]

    assert kind("date", ["2024-01-03", "2024-02-01", "hello"]) == "date"
    assert kind("when_made", ["2024-01-03", "2024-02-01", "hello"]) == "categorical"
    assert kind("created_at", ["2024-01-03", "2024-02-01", "hello"]) == "categorical"
    assert kind("d", ["25/12/2024", "03/02/2024"]) == "date"
    assert kind("d", ["2024-01-03", "03/02/2024"]) == "categorical"
    assert kind("date", ["2024-01-03", "03/02/2024"]) == "date"


def test_only_the_first_200_values_decide_without_a_hint(spark):
    early = ["2024-01-03"] * 200 + [f"x{i}" for i in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(early)], "id int, d string")
    assert profiled(df)["d"]["detected_type"] == "date"


def test_samples_past_the_opening_rows(spark):
    df = spark.range(20000).selectExpr("id", "CASE WHEN id >= 15000 THEN concat('v', id) END AS late",
                                       "CASE WHEN id % 5000 = 0 THEN 'rare' END AS rare")
    got = profiled(df)
    assert got["late"]["sample_values"] == [f"v{i}" for i in range(15000, 15005)]
    assert got["rare"]["sample_values"] == ["rare"] * 4


def test_samples_repeat_values_and_follow_scan_order(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "b", None, "a", "c", "b", "z"]], "t string").coalesce(1)
    assert profiled(df, order=None)["t"]["sample_values"] == ["b", "b", "a", "c", "b"]


def test_long_texts_are_counted_whole(spark):
    stem = "w" * 500
    df = spark.createDataFrame([(1, stem + "a"), (2, stem + "b"), (3, stem + "a")], "id int, t string")
    assert profiled(df)["t"]["unique_count"] == 2


def counts(df, **kw):
    row = profile.duplicate_counts(df, **kw).first()
    return row["row_count"], row["duplicate_row_count"]


def test_duplicates_treat_nulls_and_nans_as_equal(spark):
    nan = float("nan")
    rows = [(None, "a", nan), (None, "a", nan), ("a", None, 0.0), ("a", None, -0.0), ("b", None, 1.0)]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert counts(df) == (5, 2)
    assert counts(df, broadcast_rows=0) == (5, 2)


def test_duplicates_with_a_hot_row_and_none(spark):
    hot = spark.range(900).selectExpr("CASE WHEN id < 400 THEN 0 ELSE id END AS v", "'t' AS t")
    assert counts(hot) == (900, 399)
    assert counts(spark.range(50).toDF("v")) == (50, 0)
    assert counts(spark.range(0).toDF("v")) == (0, 0)


def test_null_position_matters_for_duplicates(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert counts(df) == (2, 0)


def test_overrides_warnings_digest(spark, mixed):
    base = profile.profile_columns(mixed.select("id", "amount", "note"), ["id"])
    roles = {r["name"]: r["role"] for r in profile.with_role_overrides(base, {"note": "ignore"}).collect()}
    assert roles == {"id": "measure", "amount": "measure", "note": "ignore"}
    assert profile.without_ignored(mixed, {"note": "ignore", "id": "dimension"}).columns[:2] == ["id", "amount"]
    warned = {r["name"]: r for r in profile.missing_warnings(base).collect()}
    assert warned["amount"]["high_missing"] and warned["id"]["missing_text"] == "—"
    lines = profile.digest(base).first()["digest"].split("\n")
    assert lines[0] == "  - 'id': numeric, role=measure, e.g. [0, 1]"
    assert lines[2] == "  - 'note': text, role=dimension, e.g. ['text number 0', 'text number 1']"


def test_common_date_texts(spark):
    from kpiloom.functions.dates import DATE_FORMATS, parses

    texts = ["1/5/2024", "2024-01-05T10:00:00Z", "2024-01-05T10:00:00+05:30", "1/5/2024 3:04 PM", "05-Jan-2024",
             "Jan 5, 2024", "  2024-01-05  ", "not 1 date", "2024"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    any_format = F.greatest(*[parses(F.col("t"), p).cast("int") for p in DATE_FORMATS])
    assert [r["ok"] for r in rows.select(any_format.alias("ok")).collect()] == [1] * 7 + [0, 0]
