"""Header, slug, title and number text; no table needed beyond one row."""

from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from kpiloom.functions import text
from kpiloom.functions.numbers import formatted, plain_number


def test_headers_of_the_edge_fixture():
    assert text.normalise_headers([" Total Dials ", "Total-Dials", "PTP %", "café"]) == [
        "total_dials", "total_dials_1", "ptp", "café"]


def test_repeated_headers_are_numbered_in_order():
    assert text.normalise_headers(["c", "C ", "c"]) == ["c", "c_1", "c_2"]


def test_repaired_edges():
    names = text.normalise_headers(["a", "a", "a_1", "###", "!!"])
    assert names[:2] == ["a", "a_1"]
    assert len(set(names)) == 5 and all(names)


@given(st.lists(st.text(max_size=12), max_size=12))
def test_headers_are_unique_non_empty_and_stable(names):
    once = text.normalise_headers(names)
    assert len(set(once)) == len(names) and all(once)
    assert text.normalise_headers(once) == once


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_slugs_titles_and_files(spark):
    assert one(spark, text.slug(F.lit("PTP Kept Rate"))) == "ptp_kept_rate"
    assert one(spark, text.slug(F.lit("!!!"))) == ""
    assert one(spark, text.chart_title(F.lit("conversion_rate"))) == "Conversion Rate"
    assert one(spark, text.chart_title(F.lit("a_b"), F.lit("team"))) == "A B by team"
    for name, ext, stem in [("Week.1.CSV", ".csv", "Week.1"), ("file", "", "file"), ("x.", ".", "x")]:
        assert one(spark, text.extension(F.lit(name))) == ext
        assert one(spark, text.stem(F.lit(name))) == stem


def test_formula_identifiers_keep_the_left_hand_name(spark):
    found = one(spark, text.formula_identifiers(F.lit("conversion_rate = payments / contacts * 2")))
    assert found == ["conversion_rate", "payments", "contacts"]


def test_completion_marker(spark):
    reply = F.lit("All set.\n[INTERVIEW_COMPLETE] ")
    assert one(spark, text.has_completion_marker(reply))
    assert one(spark, text.without_completion_marker(reply)) == "All set."


def test_bounds_print_as_written(spark):
    for value, shown in [(0.0, "0"), (0.5, "0.5"), (1000.0, "1000"), (100.0, "100"), (0.0001, "0.0001")]:
        assert one(spark, plain_number(F.lit(value))) == shown


def test_display_formats(spark):
    cases = [(0.1234, "percentage", "12.34%"), (1234567.0, "integer", "1,234,567"),
             (1234.5, "currency", "$1,234.50"), (3725.0, "duration", "01:02:05"), (1.5, "other", "1.5")]
    for value, kind, shown in cases:
        assert one(spark, formatted(F.lit(value), F.lit(kind))) == shown
    assert one(spark, formatted(F.lit(None).cast("double"), F.lit("integer"))) is None
    assert one(spark, formatted(F.lit(0.5), F.lit("mixed"), F.lit("percentage"))) == "50.00%"
