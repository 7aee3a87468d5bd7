"""Requests, review queue, decisions, state, logs, recipes' child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kpiloom.operators import governance, recipe
from kpiloom.operators.interview import decode_answers
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table
from kpiloom.schemas import TEMPLATE_IDS
from kpiloom.session import scratch_path
from kpiloom.sources import sinks
from kpiloom.streaming import state


@query("requests_by_requester", """
    SELECT request_id, created_by, template_type, status, created_at FROM requests WHERE created_by = 'user_7'""")
def requests_by_requester(spark, sf_dir):
    mine = governance.requests_of(table(spark, sf_dir, "requests"), "user_7")
    return mine.select("request_id", "created_by", "template_type", "status", "created_at")


_TEMPLATES_TEXT = str(TEMPLATE_IDS).replace("'", "''")


@query("intake_validation", f"""
    SELECT r.request_id, CASE
        WHEN r.template_type NOT IN ('client_health_dashboard', 'wbr_qbr', 'exec_scorecard', 'kpi_spotlight')
        THEN 'Unknown template ''' || r.template_type || '''. Choose from: {_TEMPLATES_TEXT}'
        WHEN k.missing IS NOT NULL THEN 'KPI IDs not found in catalog: [''' || k.missing || ''']' END AS error,
        CASE WHEN r.template_type NOT IN ('client_health_dashboard', 'wbr_qbr', 'exec_scorecard', 'kpi_spotlight')
                  OR k.missing IS NOT NULL THEN '' ELSE COALESCE(k.pending, '') END AS unreviewed_kpis
    FROM requests r LEFT JOIN (
        SELECT q.request_id, string_agg(q.kpi_id, ''', ''' ORDER BY position) FILTER (c.kpi_id IS NULL) AS missing,
               string_agg(q.kpi_id, ',' ORDER BY position) FILTER (NOT c.reviewed) AS pending
        FROM requested q LEFT JOIN part_catalog c ON c.kpi_id = q.kpi_id GROUP BY q.request_id) k
    ON k.request_id = r.request_id""")
def intake_validation(spark, sf_dir):
    lists = table(spark, sf_dir, "request_lists").select(
        "request_id", F.split("kpis", ",").alias("kpi_list"))
    requests = table(spark, sf_dir, "requests").join(lists, "request_id")
    checked = governance.validate_intake(requests, table(spark, sf_dir, "part_catalog"))
    return checked.select("request_id", "error", F.array_join("unreviewed_kpis", ",").alias("unreviewed_kpis"))


@query("review_queue_view", """
    SELECT e.entry_id, e.entry_seq, e.status, r.request_id, r.template_type, r.client_id, r.created_by
    FROM review_entries e JOIN requests r ON r.request_id = e.request_id WHERE e.status = 'pending'""")
def review_queue_view(spark, sf_dir):
    queue = governance.review_queue(table(spark, sf_dir, "review_entries"), table(spark, sf_dir, "requests"))
    return queue.select("entry_id", "entry_seq", "status", "request_id", "template_type", "client_id", "created_by")


NEW_KPIS = {"new_rows": """
    SELECT e.entry_id, q.position, q.kpi_id, c.display_name FROM review_entries e
    JOIN requested q ON q.request_id = e.request_id JOIN part_catalog c ON c.kpi_id = q.kpi_id WHERE NOT c.reviewed"""}


def new_rows(spark, sf_dir):
    return governance.new_kpis(
        table(spark, sf_dir, "review_entries"), table(spark, sf_dir, "requested"),
        table(spark, sf_dir, "part_catalog"))


@query("new_kpis_for_review", "SELECT entry_id, position, kpi_id, display_name FROM new_rows", NEW_KPIS)
def new_kpis_for_review(spark, sf_dir):
    return new_rows(spark, sf_dir)


@query("new_kpi_counts", "SELECT entry_id, COUNT(*) AS count FROM new_rows GROUP BY entry_id", NEW_KPIS)
def new_kpi_counts(spark, sf_dir):
    return governance.new_kpi_counts(new_rows(spark, sf_dir))


DECIDED = {
    "last_decisions": """
        SELECT entry_id, MAX(seq) AS seq, arg_max(decision, seq) AS decision,
               arg_max(COALESCE(reviewer_notes, ''), seq) AS notes, arg_max(COALESCE(override_value, -1), seq) AS v,
               arg_max(reviewed_at, seq) AS reviewed_at FROM decisions GROUP BY entry_id""",
}


def decided(spark, sf_dir):
    none = F.create_map().cast("map<string,double>")
    decisions = table(spark, sf_dir, "decisions").withColumn(
        "overrides", F.when(F.col("override_value").isNotNull(),
                            F.create_map(F.lit("gross_sales"), "override_value")).otherwise(none))
    entries = table(spark, sf_dir, "review_entries").withColumns({
        "reviewer_notes": F.lit(None).cast("string"), "reviewed_at": F.lit(None).cast("timestamp_ntz"),
        "overrides": F.lit(None).cast("map<string,double>")})
    return governance.apply_decisions(entries, table(spark, sf_dir, "requests"), decisions)


@query("review_decisions", """
    SELECT e.entry_id, e.request_id, COALESCE(d.decision, e.status) AS status, d.notes AS reviewer_notes,
           CASE WHEN d.decision = 'approved' AND d.v >= 0 THEN d.v END AS override_value, d.reviewed_at
    FROM review_entries e LEFT JOIN last_decisions d ON d.entry_id = e.entry_id""", DECIDED)
def review_decisions(spark, sf_dir):
    entries, _ = decided(spark, sf_dir)
    return entries.select("entry_id", "request_id", "status", "reviewer_notes",
                          F.try_element_at("overrides", F.lit("gross_sales")).alias("override_value"),
                          "reviewed_at")


@query("request_outcomes", """
    SELECT r.request_id, COALESCE(o.decision, r.status) AS status FROM requests r
    LEFT JOIN (SELECT e.request_id, arg_max(d.decision, d.seq) AS decision FROM review_entries e
               JOIN last_decisions d ON d.entry_id = e.entry_id GROUP BY e.request_id) o
    ON o.request_id = r.request_id""", DECIDED)
def request_outcomes(spark, sf_dir):
    _, requests = decided(spark, sf_dir)
    return requests.select("request_id", "status")


LATEST_STATE = """
    SELECT user_id AS request_id,
           arg_max('state ' || CAST(event_id AS STRING), event_id) FILTER (event_type IN ('view', 'error')) AS status,
           arg_max('file ' || CAST(event_id AS STRING), event_id) FILTER (event_type = 'click') AS file_path,
           arg_max(CAST(event_id AS STRING), event_id) FILTER (event_type IN ('error', 'purchase')) AS flags,
           MAX(ts) AS updated_at FROM events GROUP BY user_id"""
STATE_FIELDS = ["status", "file_path", "flags"]


def request_updates(events: DataFrame) -> DataFrame:
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    carried = F.map_from_entries(F.array_compact(F.array(
        F.when(kind.isin("view", "error"),
               F.struct(F.lit("status"), F.concat(F.lit("state "), number))),
        F.when(kind == "click", F.struct(F.lit("file_path"), F.concat(F.lit("file "), number))),
        F.when(kind.isin("error", "purchase"), F.struct(F.lit("flags"), number)),
    )))
    return events.select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("seq"), carried.alias("changes"),
        F.col("ts").alias("updated_at"))


@query("latest_request_state", LATEST_STATE)
def latest_request_state(spark, sf_dir):
    return governance.latest_state(request_updates(table(spark, sf_dir, "events")), STATE_FIELDS)


@query("latest_request_state_stream", LATEST_STATE)
def latest_request_state_stream(spark, sf_dir):
    """All events as a stream of files in two runs; the later half arrives first, and half of it arrives again."""
    events = table(spark, sf_dir, "events")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    root = scratch_path(spark, "latest-state")
    late = F.col("event_id") > F.lit(middle).cast("bigint")
    again = events.where(late & (F.col("event_id") % 2 == 0))
    for part in (events.where(late), events.where(~late).unionByName(again)):
        part.repartition(2).write.mode("append").parquet(f"{root}/files")
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/files")
        state.follow(request_updates(arriving), STATE_FIELDS, f"{root}/state", f"{root}/checkpoint")
    return state.current_state(spark, f"{root}/state", STATE_FIELDS)


@query("review_enqueue", """
    SELECT substr(sha256(request_id || ':' || CAST(o_custkey AS STRING)), 1, 32) AS entry_id, request_id,
           'pending' AS status, CAST(NULL AS VARCHAR) AS reviewer_notes
    FROM (SELECT CAST(o_orderkey AS STRING) AS request_id, o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def review_enqueue(spark, sf_dir):
    generated = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(
        F.col("o_orderkey").cast("string").alias("request_id"), F.col("o_custkey").alias("run_seq"))
    return governance.enqueue_reviews(generated)


@query("step_log", """
    SELECT CAST(user_id AS STRING) AS request_id, 'compute' AS step, event_type AS read_type,
           props AS output, CAST(event_id % 5000 AS INTEGER) AS latency_ms FROM events""")
def step_log(spark, sf_dir):
    """Appended to a log table and read back."""
    steps = table(spark, sf_dir, "events").withColumn("request_id", F.col("user_id").cast("string"))
    rows = sinks.log_rows(steps, "compute", F.struct("event_type", "value"), F.col("props"),
                          F.col("event_id") % 5000)
    path = scratch_path(spark, "step_log")
    sinks.append_log(rows, path)
    return spark.read.parquet(path).select(
        "request_id", "step", F.get_json_object("input", "$.event_type").alias("read_type"), "output",
        "latency_ms")


@query("auto_approval", """
    SELECT r.request_id, m.client_id IS NOT NULL AS has_mapping,
           COALESCE(r.h = m.h, FALSE) AS same_headers, r.range_count = 0 AS in_range, r.flag_count = 0 AS no_flags,
           COALESCE(r.k = m.k, FALSE) AS same_kpis,
           m.client_id IS NOT NULL AND COALESCE(r.h = m.h, FALSE) AND r.range_count = 0 AND r.flag_count = 0 AND COALESCE(r.k = m.k, FALSE) AS auto_approved
    FROM (SELECT CAST(o_orderkey AS STRING) AS request_id, 'client_' || CAST(o_custkey AS STRING) AS client_id,
                 o_orderstatus AS h, o_custkey % 2 AS k, o_orderkey % 4 AS flag_count, o_orderkey % 3 AS range_count FROM orders) r
    LEFT JOIN (SELECT 'client_' || CAST(c_custkey AS STRING) AS client_id, CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'O' END AS h,
                      c_nationkey % 2 AS k FROM customer WHERE c_mktsegment <> 'BUILDING') m ON m.client_id = r.client_id""")
def auto_approval(spark, sf_dir):
    def pack(h, k):
        return (F.array(F.lit("date"), h).alias("headers"),
                F.array(F.lit("gross_sales"), F.concat(F.lit("kpi_"), k.cast("string"))).alias("kpi_list"))

    orders = table(spark, sf_dir, "orders").withColumn("request_id", F.col("o_orderkey").cast("string"))
    requests = orders.select(
        "request_id", F.concat(F.lit("client_"), F.col("o_custkey").cast("string")).alias("client_id"),
        F.lit("wbr_qbr").alias("template_type"), *pack(F.col("o_orderstatus"), F.col("o_custkey") % 2))
    memory = table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.concat(F.lit("client_"), F.col("c_custkey").cast("string")).alias("client_id"),
        F.lit("wbr_qbr").alias("template_type"),
        *pack(F.when(F.col("c_nationkey") % 2 == 0, "F").otherwise("O"), (F.col("c_nationkey") % 2)))
    flags = orders.select("request_id", (F.col("o_orderkey") % 4).alias("flag_count"))
    outside = orders.select("request_id", (F.col("o_orderkey") % 3).alias("out_of_range_count"))
    return governance.auto_approval(requests, memory, flags, outside)


def typed_answers(spark, sf_dir):
    """Interview answers complete enough for a recipe."""
    parsed = decode_answers(table(spark, sf_dir, "answer_texts"), "answer").withColumnRenamed(
        "answers", "a")
    complete = parsed.where("a.date_column IS NOT NULL AND a.kpis IS NOT NULL AND a.filters IS NOT NULL")
    return complete.select("upload_id", "dataset_id", "a.*")


ANSWERS = {
    "typed_answers": """
        SELECT upload_id, dataset_id, a,
               COALESCE(from_json(a->'kpis', '[{"name": "VARCHAR", "formula": "VARCHAR"}]'), []) AS kpis,
               COALESCE(from_json(a->'dimensions', '["VARCHAR"]'), []) AS dimensions,
               COALESCE(from_json(a->'filters', '["VARCHAR"]'), []) AS filters
        FROM (SELECT *, CASE WHEN json_valid(answer) THEN answer::JSON END AS a FROM answer_texts)
        WHERE a->>'date_column' IS NOT NULL AND a->>'kpis' IS NOT NULL AND a->>'filters' IS NOT NULL""",
    "numbered_kpis": """
        SELECT upload_id, dimensions, unnest(kpis) AS k, generate_subscripts(kpis, 1) AS i FROM typed_answers""",
}
_TITLE = "array_to_string(list_transform(string_split(replace(k.name, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


@query("recipe_charts", f"""
    SELECT upload_id, 'line' AS type, k.name AS kpi, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS group_by, CAST(i - 1 AS INTEGER) AS position
    FROM numbered_kpis
    UNION ALL
    SELECT upload_id, 'bar', k.name, {_TITLE} || ' by ' || dimensions[1], dimensions[1],
           CAST((SELECT COUNT(*) FROM numbered_kpis m WHERE m.upload_id = n.upload_id) + i - 1 AS INTEGER)
    FROM numbered_kpis n WHERE i <= 2 AND len(dimensions) > 0""", ANSWERS)
def recipe_charts(spark, sf_dir):
    recipes = recipe.generate_recipes(typed_answers(spark, sf_dir))
    return recipe.layout_rows(recipes)


@query("recipe_columns", r"""
    SELECT upload_id, string_agg(DISTINCT c, ',' ORDER BY c) AS columns FROM (
        SELECT upload_id, a->>'date_column' AS c FROM typed_answers
        UNION ALL SELECT upload_id, unnest(dimensions) FROM typed_answers
        UNION ALL SELECT upload_id, unnest(filters) FROM typed_answers
        UNION ALL SELECT upload_id, unnest(regexp_extract_all(k.formula, '\b[a-zA-Z_][a-zA-Z0-9_]*\b')) FROM numbered_kpis)
    GROUP BY upload_id""", ANSWERS)
def recipe_columns(spark, sf_dir):
    recipes = recipe.generate_recipes(typed_answers(spark, sf_dir))
    return recipes.select(
        "upload_id", F.array_join(F.map_keys("column_mappings"), ",").alias("columns"))


@query("formula_identifiers", r"""
    SELECT upload_id, i - 1 AS kpi_pos, array_to_string(regexp_extract_all(k.formula, '\b[a-zA-Z_][a-zA-Z0-9_]*\b'), ',') AS names
    FROM numbered_kpis""", ANSWERS)
def formula_identifiers(spark, sf_dir):
    from kpiloom.functions.text import formula_identifiers as names_of

    return typed_answers(spark, sf_dir).select("upload_id", F.posexplode("kpis").alias("p", "k")).select(
        "upload_id", F.col("p").cast("bigint").alias("kpi_pos"),
        F.array_join(names_of(F.col("k.formula")), ",").alias("names"))


@query("chart_titles", """
    SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' '
           || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' by ' || p_brand AS title
    FROM part""")
def chart_titles(spark, sf_dir):
    from kpiloom.functions.text import chart_title

    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return table(spark, sf_dir, "part").select("p_partkey", chart_title(name, F.col("p_brand")).alias("title"))


RECIPES = {
    "approved": "SELECT user_id AS recipe_id, event_id, ts, event_type FROM events WHERE event_type <> 'error'",
    "last_approved": """
        SELECT recipe_id, MAX(event_id) AS event_id, arg_max(ts, event_id) AS ts, arg_max(event_type, event_id) AS event_type
        FROM approved GROUP BY recipe_id""",
}


def recipe_approvals(spark, sf_dir):
    one = F.array(F.struct(F.concat(F.lit("edited_"), "event_type").alias("name"), F.lit("a / b").alias("formula")))
    last = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(
        F.col("user_id").alias("recipe_id")).agg(
        F.max(F.struct("event_id", "ts", "event_type")).alias("e")).select("recipe_id", "e.*")
    approvals = last.select(
        "recipe_id", F.concat(F.lit("by_"), "event_type").alias("approved_by"),
        F.col("ts").alias("approved_at"),
        F.when(F.col("event_type").isin("click", "view"), one).alias("kpis"))
    recipes = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("recipe_id"), F.concat(F.lit("client_"), F.col("c_nationkey").cast("string")).alias("client_id"),
        F.array(F.struct(F.lit("first").alias("name"), F.lit("a").alias("formula"))).alias("kpis"),
        F.lit(None).cast("string").alias("approved_by"), F.lit(None).cast("timestamp_ntz").alias("approved_at"))
    definitions = recipes.select("client_id", "recipe_id", F.explode("kpis").alias("k")).select(
        "client_id", "recipe_id", "k.*")
    return recipe.approve_recipes(recipes, approvals, definitions)


@query("recipe_child_rows", """
    SELECT 'client_' || CAST(c_nationkey AS STRING) AS client_id, c_custkey AS recipe_id,
           CASE WHEN a.event_type IN ('click', 'view') THEN 'edited_' || a.event_type ELSE 'first' END AS name,
           CASE WHEN a.event_type IN ('click', 'view') THEN 'a / b' ELSE 'a' END AS formula
    FROM customer LEFT JOIN last_approved a ON a.recipe_id = c_custkey""", RECIPES)
def recipe_child_rows(spark, sf_dir):
    return recipe_approvals(spark, sf_dir)[1]


@query("recipe_stamps", """
    SELECT c_custkey AS recipe_id, 'by_' || a.event_type AS approved_by, a.ts AS approved_at
    FROM customer LEFT JOIN last_approved a ON a.recipe_id = c_custkey""", RECIPES)
def recipe_stamps(spark, sf_dir):
    return recipe_approvals(spark, sf_dir)[0].select("recipe_id", "approved_by", "approved_at")


@query("interview_progress", """
    SELECT upload_id, step AS step_index, ['Date column', 'KPI definitions', 'Dimensions', 'Time granularity', 'Filters'][step] AS step_label,
           step = 5 AND filters_given AS completed
    FROM (SELECT upload_id, CASE WHEN upload_id % 13 = 0 OR upload_id % 5 = 0 THEN 1 WHEN upload_id % 7 = 0 THEN 2
                 WHEN upload_id % 11 = 0 THEN 3 WHEN upload_id % 17 = 0 THEN 4 ELSE 5 END AS step,
                 upload_id % 3 <> 0 AS filters_given FROM answer_texts)""")
def interview_progress(spark, sf_dir):
    from kpiloom.operators.interview import with_progress

    done = with_progress(table(spark, sf_dir, "answer_texts"), "answer")
    return done.select("upload_id", "step_index", "step_label", "completed")


@query("conversation_transcript", """
    SELECT conv_id, turn // 4 AS page,
           string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS transcript
    FROM conversations GROUP BY conv_id, turn // 4""")
def conversation_transcript(spark, sf_dir):
    from kpiloom.operators.interview import transcripts

    return transcripts(table(spark, sf_dir, "conversations"), turns_per_page=4)


@query("completion_markers", r"""
    SELECT conv_id, turn, m LIKE '%[INTERVIEW_COMPLETE]%' AS done,
           regexp_replace(replace(m, '[INTERVIEW_COMPLETE]', ''), '^\s+|\s+$', '', 'g') AS reply
    FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || ' [INTERVIEW_COMPLETE] ' ELSE text END AS m
          FROM conversations)""")
def completion_markers(spark, sf_dir):
    from kpiloom.functions.text import has_completion_marker, without_completion_marker

    marked = table(spark, sf_dir, "conversations").withColumn("m", F.when(
        F.col("turn") % 3 == 0, F.concat("text", F.lit(" [INTERVIEW_COMPLETE] "))).otherwise(F.col("text")))
    return marked.select("conv_id", "turn", has_completion_marker(F.col("m")).alias("done"),
                         without_completion_marker(F.col("m")).alias("reply"))
