import json

from pyspark.sql import functions as F

from kpiloom.operators import governance, interview, recipe, report
from kpiloom.plans.fixtures import catalog_frame, template_frame
from kpiloom.sources.catalog_files import template_charts


def results(spark):
    rows = [("1", 0, "units_sold", True, 5.0, ["f"], ["units_sold: f"]), ("1", 1, "gone", False, None, [], ["gone: not found in catalog"]),
            ("1", 2, "missing_num", True, None, ["g"], ["missing_num: g"])]
    return spark.createDataFrame(rows, (
        "request_id string, position int, kpi_id string, in_catalog boolean, value double, flags array<string>, "
        "report_flags array<string>"))


def documents(spark):
    requests = spark.createDataFrame(
        [("1", "exec_scorecard", "c", "2024-01-01", None), ("2", "nowhere", None, None, None)],
        "request_id string, template_type string, client_id string, period_start string, period_end string")
    built = report.build_reports(requests, results(spark), catalog_frame(spark), template_frame(spark))
    return built, {r["request_id"]: json.loads(r["document"]) for r in report.report_documents(built).collect()}


def test_documents(spark):
    built, docs = documents(spark)
    first = docs["1"]
    assert first["data_quality_flags"] == ["units_sold: f", "gone: not found in catalog", "missing_num: g"]
    assert [t["kpi_id"] for t in first["kpi_tiles"]] == ["units_sold", "missing_num"]
    assert first["kpi_tiles"][1]["display_name"] == "missing_num" and first["kpi_tiles"][1]["value"] is None
    assert [(c["chart_id"], [s["kpi_id"] for s in c["series"]]) for c in first["charts"]] == [
        ("units", ["units_sold"]), ("empty", [])]
    assert first["charts"][1]["x_axis"] == "date" and first["charts"][1]["y_format"] == "percentage"
    assert docs["2"] == {"template_type": "nowhere", "client_id": None, "period_start": None, "period_end": None,
                         "kpi_tiles": [], "charts": [], "data_quality_flags": []}
    series = report.chart_series(built).collect()
    assert [(r["chart_id"], r["kpi_id"]) for r in series] == [("units", "units_sold"), ("empty", None)]


def test_templates_are_found_by_id_from_files(spark, tmp_path):
    from kpiloom.plans.fixtures import TEMPLATES
    from kpiloom.sources.catalog_files import read_templates

    for i, t in enumerate(TEMPLATES):
        (tmp_path / f"file_{i}.json").write_text(json.dumps(t, indent=2))
    found = read_templates(spark, str(tmp_path))
    assert sorted(r["template_id"] for r in found.collect()) == sorted(t["template_id"] for t in TEMPLATES)
    assert template_charts(found).count() == sum(len(t["charts"]) for t in TEMPLATES)


def test_spotlight_placeholders(spark):
    charts = template_charts(template_frame(spark)).where("template_id = 'kpi_spotlight'")
    rows = report.resolve_spotlight(charts, F.lit("units_sold"), F.lit("Units Sold"), F.lit("integer"), F.lit("site"))
    got = {r["chart_id"]: r for r in rows.collect()}
    assert got["one_bar"]["title"] == "Units Sold by site" and got["one_bar"]["x_axis"] == "site"
    assert got["one_line"]["kpi"] == "units_sold" and got["one_line"]["y_format"] == "integer"
    assert got["one_line"]["x_axis"] == "date" and got["one_line"]["kpis"] == ["units_sold"]


def test_overrides(spark):
    entries = spark.createDataFrame([("1", 1, {"units_sold": 9.0, "other": 1.0})], "request_id string, entry_seq int, overrides map<string,double>")
    got = {r["kpi_id"]: (r["value"], r["overridden"]) for r in report.apply_overrides(results(spark), entries).collect()}
    assert got == {"units_sold": (9.0, True), "gone": (None, False), "missing_num": (None, False)}


def queue(spark):
    entries = spark.createDataFrame([("e1", 1, "r1", "pending"), ("e2", 2, "r2", "pending"), ("e3", 3, "r1", "approved")],
                                    "entry_id string, entry_seq int, request_id string, status string")
    requests = spark.createDataFrame(
        [("r1", "t", "c", None, None, "u", "review", 1), ("r2", "t", "c", None, None, "u", "review", 2)],
        "request_id string, template_type string, client_id string, period_start string, period_end string, "
        "created_by string, status string, created_at int")
    return entries, requests


def test_pending_queue_newest_first(spark):
    entries, requests = queue(spark)
    assert [r["entry_id"] for r in governance.review_queue(entries, requests).collect()] == ["e2", "e1"]
    assert [r["entry_id"] for r in governance.review_queue(entries, requests, None).collect()] == ["e3", "e2", "e1"]
    assert [r["request_id"] for r in governance.requests_of(requests, "u").collect()] == ["r2", "r1"]


def test_decisions(spark):
    entries, requests = queue(spark)
    entries = entries.withColumns({"reviewer_notes": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("int"),
                                   "overrides": F.lit(None).cast("map<string,double>")})
    decisions = spark.createDataFrame(
        [("e1", 1, "approved", None, {"k": 1.0}, 5), ("e2", 2, "rejected", "no", {"k": 2.0}, 6),
         ("e2", 1, "approved", "yes", {}, 4), ("e1", 0, "rejected", "early", {}, 3)],
        "entry_id string, seq int, decision string, reviewer_notes string, overrides map<string,double>, reviewed_at int")
    after, reqs = governance.apply_decisions(entries, requests, decisions)
    got = {r["entry_id"]: (r["status"], r["reviewer_notes"], r["overrides"], r["reviewed_at"]) for r in after.collect()}
    assert got == {"e1": ("approved", "", {"k": 1.0}, 5), "e2": ("rejected", "no", None, 6), "e3": ("approved", None, None, None)}
    assert {r["request_id"]: r["status"] for r in reqs.collect()} == {"r1": "approved", "r2": "rejected"}


def test_latest_state_keeps_fields_not_carried(spark):
    updates = spark.createDataFrame(
        [("r", 1, {"status": "intake", "client_id": "c"}, 10), ("r", 3, {"client_id": None}, 30), ("r", 2, {"status": "computed"}, 20)],
        "request_id string, seq int, changes map<string,string>, updated_at int")
    row = governance.latest_state(updates, ["status", "client_id", "file_path"]).first()
    assert row.asDict() == {"request_id": "r", "status": "computed", "client_id": None, "file_path": None, "updated_at": 30}


def test_intake_errors_in_request_order(spark):
    requests = spark.createDataFrame(
        [("1", "wbr_qbr", ["z", "a", "y"]), ("2", "pack", ["a"]), ("3", "wbr_qbr", ["b", "a"]), ("4", "wbr_qbr", [])],
        "request_id string, template_type string, kpi_list array<string>")
    known = spark.createDataFrame([("a", True), ("b", False)], "kpi_id string, reviewed boolean")
    got = {r["request_id"]: r for r in governance.validate_intake(requests, known).collect()}
    assert got["1"]["error"] == "KPI IDs not found in catalog: ['z', 'y']" and not got["1"]["accepted"]
    assert got["2"]["error"].startswith("Unknown template 'pack'. Choose from: ['client_health_dashboard',")
    assert got["3"]["accepted"] and got["3"]["unreviewed_kpis"] == ["b"]
    assert got["4"]["accepted"] and got["4"]["missing_kpis"] == []


def test_recipe_generation(spark):
    answers = spark.createDataFrame(
        [(1, 2, "day", [("a", "a = x / y"), ("b_c", "z"), ("c", "x + 1")], ["team", "site"], "weekly", ["team"]),
         (2, 2, "day", [("a", "x")], [], "weekly", [])],
        "upload_id int, dataset_id int, date_column string, kpis array<struct<name: string, formula: string>>, "
        "dimensions array<string>, granularity string, filters array<string>")
    rows = {r["upload_id"]: r for r in recipe.generate_recipes(answers).collect()}
    layout = [(c["type"], c["kpi"], c["title"], c["group_by"]) for c in rows[1]["chart_layout"]]
    assert layout == [("line", "a", "A", None), ("line", "b_c", "B C", None), ("line", "c", "C", None),
                      ("bar", "a", "A by team", "team"), ("bar", "b_c", "B C by team", "team")]
    assert sorted(rows[1]["column_mappings"]) == ["a", "day", "site", "team", "x", "y", "z"]
    assert len(rows[2]["chart_layout"]) == 1


def test_approving_without_edits_keeps_child_rows(spark):
    recipes = spark.createDataFrame([(1, "c", [("a", "x")], None, None), (2, "c", [("b", "y")], "old", 1)],
                                    "recipe_id int, client_id string, kpis array<struct<name: string, formula: string>>, approved_by string, approved_at int")
    approvals = spark.createDataFrame([(1, "u", 9, [("n", "z"), ("m", "w")])],
                                      "recipe_id int, approved_by string, approved_at int, kpis array<struct<name: string, formula: string>>")
    definitions = spark.createDataFrame([("c", 1, "a", "x"), ("c", 2, "b", "y")], "client_id string, recipe_id int, name string, formula string")
    stamped, children = recipe.approve_recipes(recipes, approvals, definitions)
    assert {r["recipe_id"]: r["approved_by"] for r in stamped.collect()} == {1: "u", 2: "old"}
    assert sorted((r["recipe_id"], r["name"]) for r in children.collect()) == [(1, "m"), (1, "n"), (2, "b")]
    plain = approvals.withColumn("kpis", F.lit(None).cast("array<struct<name: string, formula: string>>"))
    _, same = recipe.approve_recipes(recipes, plain, definitions)
    assert sorted((r["recipe_id"], r["name"]) for r in same.collect()) == [(1, "a"), (2, "b")]


def test_interview_progress(spark):
    full = '{"date_column": "d", "kpis": [{"name": "a", "formula": "x"}], "dimensions": ["t"], "granularity": "daily", "filters": %s}'
    docs = spark.createDataFrame([(1, full % "null"), (2, full % "[]"), (3, "{broken"), (4, '{"date_column": "d", "kpis": []}')],
                                 "id int, doc string")
    got = {r["id"]: (r["step_index"], r["step_label"], r["completed"]) for r in interview.with_progress(docs, "doc").collect()}
    assert got == {1: (5, "Filters", False), 2: (5, "Filters", True), 3: (1, "Date column", False), 4: (2, "KPI definitions", False)}


def test_transcript_pages_join_to_the_whole(spark):
    rows = [(1, t, r, f"line {t}") for t, r in enumerate(["user", "assistant", "system", "user", "assistant"])]
    pages = interview.transcripts(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), turns_per_page=2)
    whole = "\n".join(r["transcript"] for r in pages.orderBy("page").collect())
    assert whole == "User: line 0\nAssistant: line 1\nAssistant: line 2\nUser: line 3\nAssistant: line 4"
    assert pages.count() == 3


def test_the_latest_of_two_overrides_counts(spark):
    results = spark.createDataFrame([("r", "k", 1.0), ("r", "other", 2.0)], "request_id string, kpi_id string, value double")
    entries = spark.createDataFrame(
        [("r", 2, {"k": 20.0}), ("r", 1, {"k": 10.0})], "request_id string, entry_seq int, overrides map<string,double>")
    got = [(r["kpi_id"], r["value"], r["overridden"]) for r in report.apply_overrides(results, entries).orderBy("kpi_id").collect()]
    assert got == [("k", 20.0, True), ("other", 2.0, False)]
