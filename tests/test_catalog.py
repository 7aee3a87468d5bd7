import random
import re

from pyspark.sql import functions as F

from kpiloom.operators import catalog
from kpiloom.sources.catalog_files import parse_catalog


def slug(name):
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def one_by_one(names, existing):
    """Ids given one proposal at a time; own slugs of the batch are kept for their owners."""
    taken, own, given = set(existing), {slug(n) for n in names}, set()
    result = []
    for name in names:
        base = slug(name)
        if not base:
            result.append(None)
            continue
        n = 1
        while True:
            candidate = base if n == 1 else f"{base}_{n}"
            free = candidate not in taken and candidate not in given
            if free and (n == 1 or candidate not in own):
                break
            n += 1
        given.add(candidate)
        result.append(candidate)
    return result


def assigned(spark, names, existing, rows=1 << 20):
    proposals = spark.createDataFrame(list(enumerate(names)), "seq bigint, display_name string")
    known = spark.createDataFrame([(e,) for e in existing], "kpi_id string")
    rows = catalog.assign_ids(proposals, known, rows).collect()
    return [r["kpi_id"] for r in sorted(rows, key=lambda r: r["seq"])]


def test_ids_of_the_edge_fixture(spark):
    names = ["PTP Kept Rate", "PTP Kept Rate", "!!!"]
    assert assigned(spark, names, []) == ["ptp_kept_rate", "ptp_kept_rate_2", None]


def test_ids_skip_what_is_taken(spark):
    assert assigned(spark, ["A b", "a B", "a-b"], ["a_b", "a_b_3"]) == ["a_b_2", "a_b_4", "a_b_5"]


def test_ids_match_one_by_one_with_a_hot_name(spark):
    rng = random.Random(11)
    pool = ["Hot Rate"] * 8 + ["Cold", "Cold 2", "Hot Rate 3", "!!", "Hot Rate 12", "x"]
    names = [rng.choice(pool) for _ in range(120)]
    existing = ["hot_rate", "hot_rate_2", "hot_rate_7", "hot_rate_8", "cold_2_2", "y_5"]
    got = assigned(spark, names, existing, rows=16)
    assert got == one_by_one(names, existing)
    real = [g for g in got if g]
    assert len(set(real)) == len(real) and not set(real) & set(existing)


def test_definition_errors_in_order(spark):
    df = spark.createDataFrame([("X", "ratio", "nowhere"), ("X", "integer", "nowhere"), ("!!", "integer", "ops"),
                                ("X", "integer", "ops"), ("X", None, "ops")], "n string, f string, d string")
    errors = [r["e"] for r in df.select(catalog.definition_error(F.col("n"), F.col("f"), F.col("d")).alias("e")).collect()]
    assert errors[0].startswith("Invalid format 'ratio'. Choose from: ['percentage',")
    assert errors[1].startswith("Invalid domain 'nowhere'. Choose from: ['collections',")
    assert errors[2] == "Could not generate a valid kpi_id from the display name."
    assert errors[3] is None and errors[4].startswith("Invalid format 'None'")


def test_expected_range_and_source_fields(spark):
    df = spark.createDataFrame([(None, None), (0.0, None), (0.0, 1.0)], "a double, b double")
    got = [r["r"] for r in df.select(catalog.expected_range(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got[0] is None and got[1].asDict() == {"min": 0.0, "max": None} and got[2].asDict() == {"min": 0.0, "max": 1.0}
    rows = spark.createDataFrame([(["n", "n"], "n", "d"), (None, "n", "_none_"), (["x"], "", None), ([], "q", "q")],
                                 "s array<string>, n string, d string")
    fields = [r["f"] for r in rows.select(
        catalog.enrich_source_fields(F.col("s"), F.col("n"), F.col("d")).alias("f")).collect()]
    assert fields == [["n", "n", "d"], ["n"], ["x"], ["q"]]


def test_catalog_documents_get_defaults(spark):
    docs = spark.createDataFrame([('{"kpi_id": "k", "display_name": "K", "numerator": "a", "denominator": "_none_", '
                                   '"format": "integer", "domain": "ops", "expected_range": {}}',)], "d string")
    row = parse_catalog(docs, "d").first()
    assert row["aliases"] == [] and row["source_fields"] == [] and row["reviewed"] is False
    assert row["expected_range"] is None and row["description"] == ""


def test_control_columns_survive_a_round_trip(spark):
    rows = spark.createDataFrame([('{"min": 0}', '["a"]', None, 1), (None, None, "", None)],
                                 "expected_range string, aliases string, source_fields string, reviewed int")
    first = catalog.decode_control_columns(rows)
    again = catalog.decode_control_columns(catalog.encode_control_columns(first))
    assert first.collect() == again.collect()
    assert first.collect()[1]["aliases"] == [] and first.collect()[1]["reviewed"] is False


def test_insert_if_absent_keeps_the_first(spark):
    known = spark.createDataFrame([("a",)], "kpi_id string")
    incoming = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2)], "kpi_id string, seq int")
    inserted, conflicts = catalog.insert_if_absent(known, incoming)
    assert [(r["kpi_id"], r["seq"]) for r in inserted.collect()] == [("b", 2)]
    assert {(r["kpi_id"], r["seq"]): r["error"] for r in conflicts.collect()} == {
        ("a", 1): "KPI 'a' already exists.", ("b", 3): "KPI 'b' already exists."}


def test_promotions_ignore_unknown_ids(spark):
    known = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "kpi_id string, reviewed boolean")
    decisions = spark.createDataFrame([("a", 1, None), ("b", 1, True), ("b", 2, False), ("zz", 1, True)],
                                      "kpi_id string, seq int, reviewed boolean")
    got = {r["kpi_id"]: r["reviewed"] for r in catalog.promote(known, decisions).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_history_keeps_changes_only(spark):
    changes = spark.createDataFrame(
        [(1, 1, "a", 10), (1, 2, "a", 20), (1, 3, "b", 30), (1, 4, None, 40), (1, 5, None, 50), (1, 6, "a", 60)],
        "recipe int, seq bigint, formula string, changed_at int")
    rows = catalog.definition_history(changes, ["recipe"], rows=2).orderBy("valid_from").collect()
    assert [(r["formula"], r["valid_from"], r["valid_to"]) for r in rows] == [
        ("a", 10, 30), ("b", 30, 40), (None, 40, 60), ("a", 60, None)]
