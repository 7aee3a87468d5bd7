"""Column profiles of the given tables, samples, duplicates, digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kpiloom.operators import keyed_profile, profile
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table
from kpiloom.session import scratch_path
from kpiloom.sources import staging

# Ordering columns that stand for file order, and column types.
LAYOUT = {
    "region": (["r_regionkey"], "r_regionkey int, r_name text"),
    "nation": (["n_nationkey"], "n_nationkey int, n_name text, n_regionkey int"),
    "customer": (["c_custkey"], "c_custkey int, c_name text, c_nationkey int, c_acctbal float, c_mktsegment text"),
    "supplier": (["s_suppkey"], "s_suppkey int, s_name text, s_nationkey int, s_acctbal float"),
    "part": (["p_partkey"], "p_partkey int, p_name text, p_brand text, p_type text, p_size int, p_retailprice float"),
    "orders": (["o_orderkey"], "o_orderkey int, o_custkey int, o_orderstatus text, o_totalprice float, o_orderdate time, o_orderpriority text"),
    "lineitem": (["l_orderkey", "l_linenumber"],
                 "l_orderkey int, l_partkey int, l_suppkey int, l_linenumber int, l_quantity float, l_extendedprice float, "
                 "l_discount float, l_tax float, l_returnflag text, l_linestatus text, l_shipdate time"),
    "events": (["event_id"], "event_id int, ts time, user_id int, event_type text, value float, props text"),
    "documents": (["doc_id"], "doc_id int, text text, lang text, source text, n_chars int"),
    "labels": (["doc_id"], "doc_id int, quality int, toxic int"),
    "pages": (["page_id"], "page_id int, url text, html text"),
    "conversations": (["conv_id", "turn"], "conv_id int, turn int, role text, text text"),
    "benchmark": (["item_id"], "item_id int, text text"),
    "embeddings": (["vec_id"], "vec_id int, embedding list, label int"),
}

_RAW = {"int": "int64", "float": "float64", "time": "datetime64[ns]", "text": "object", "list": "object"}


def profile_sql(source: str, order: list[str], columns: str, dates: dict[str, str] | None = None) -> str:
    """DuckDB text of a column profile; ``dates`` gives the condition under which a text is a date."""
    parts = []
    keys = ", ".join(order)
    for i, (name, kind) in enumerate(c.strip().split(" ") for c in columns.split(",")):
        shown = f"{name} + 0.0" if kind == "float" else name
        raw = f"CASE WHEN missing > 0 THEN 'float64' ELSE 'int64' END" if kind == "int" else f"'{_RAW[kind]}'"
        if kind == "time":
            detected = "'date'"
        elif kind in ("int", "float"):
            detected = "CASE WHEN u <= 5 THEN 'categorical' ELSE 'numeric' END"
        else:
            dated = (dates or {}).get(name, "FALSE")
            detected = f"CASE WHEN {dated} THEN 'date' WHEN u <= 100 OR u <= n * 0.5 THEN 'categorical' ELSE 'text' END"
        samples = ("CAST(NULL AS VARCHAR)" if kind == "list" else f"""COALESCE((SELECT string_agg(v, ' | ' ORDER BY {keys}, v) FROM (
            SELECT {keys}, CAST({shown} AS VARCHAR) AS v FROM {source} WHERE {name} IS NOT NULL ORDER BY {keys}, v LIMIT 5)), '')""")
        parts.append(f"""
            SELECT CAST({i} AS INTEGER) AS position, '{name}' AS name, {raw} AS raw_dtype, {detected} AS detected_type, n, missing, u,
                   {samples} AS samples
            FROM (SELECT COUNT(*) AS n, COUNT(*) - COUNT({name}) AS missing, COUNT(DISTINCT {name}) AS u FROM {source})""")
    return f"""
        SELECT position, name, raw_dtype, detected_type,
               CASE detected_type WHEN 'date' THEN 'date' WHEN 'numeric' THEN 'measure' ELSE 'dimension' END AS suggested_role,
               missing AS missing_count, CASE WHEN n > 0 THEN ROUND(missing * 100 / n, 2) ELSE 0 END AS missing_pct,
               u AS unique_count, samples
        FROM ({' UNION ALL '.join(parts)})"""


def shown(frame):
    return frame.withColumn("samples", F.array_join("sample_values", " | ")).drop("sample_values")


def _register(name: str, order: list[str], columns: str) -> None:
    @query(f"profile_{name}", profile_sql(name, order, columns))
    def run(spark, sf_dir):
        result = shown(profile.profile_columns(table(spark, sf_dir, name), order))
        if " list" in columns:
            nested = F.col("name") == "embedding"
            result = result.withColumn("samples", F.when(~nested, F.col("samples")))
        return result


for _name, (_order, _columns) in LAYOUT.items():
    _register(_name, _order, _columns)


DATED = {"dated_orders": """
    SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'hello' ELSE SUBSTR(CAST(o_orderdate AS STRING), 1, 10) END AS date,
           CASE WHEN o_orderkey % 3 = 0 THEN 'hello' ELSE SUBSTR(CAST(o_orderdate AS STRING), 1, 10) END AS order_date,
           CASE WHEN o_orderkey % 10 <> 0 THEN SUBSTR(CAST(o_orderdate AS STRING), 9, 2) || '/' || SUBSTR(CAST(o_orderdate AS STRING), 6, 2)
                || '/' || SUBSTR(CAST(o_orderdate AS STRING), 1, 4) END AS shipped,
           CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS agent,
           CASE WHEN o_orderkey % 2 = 0 THEN SUBSTR(CAST(o_orderdate AS STRING), 1, 10) ELSE '03/02/2024' END AS mixed
    FROM orders"""}


def _rate(column: str, pattern: str, first: int | None) -> str:
    limit = f"ORDER BY o_orderkey LIMIT {first}" if first else ""
    return (f"(SELECT AVG(CASE WHEN try_strptime(v, '{pattern}') IS NOT NULL THEN 1 ELSE 0 END) FROM "
            f"(SELECT {column} AS v FROM dated_orders WHERE {column} IS NOT NULL {limit}))")


@query("profile_text_dates", profile_sql(
    "dated_orders", ["o_orderkey"],
    "o_orderkey int, date text, order_date text, shipped text, agent int, mixed text",
    {"date": f"{_rate('date', '%Y-%m-%d', None)} >= 0.5",
     "order_date": f"{_rate('order_date', '%Y-%m-%d', 200)} >= 0.85",
     "shipped": f"{_rate('shipped', '%d/%m/%Y', 200)} >= 0.85",
     "mixed": f"{_rate('mixed', '%Y-%m-%d', 200)} >= 0.85"}), DATED)
def profile_text_dates(spark, sf_dir):
    return shown(profile.profile_columns(dated_orders(spark, sf_dir), ["o_orderkey"]))


def dated_orders(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.substring(F.col("o_orderdate").cast("string"), 1, 10)
    often = F.when(key % 3 == 0, "hello").otherwise(day)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", often.alias("date"), often.alias("order_date"),
        F.when(key % 10 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("shipped"),
        F.when(key % 4 == 0, F.col("o_custkey")).alias("agent"),
        F.when(key % 2 == 0, day).otherwise("03/02/2024").alias("mixed"))


_GAPPY = [("event_id", ""), ("ts", ""), ("user_id", ""), ("event_type", ""), ("value", "event_type <> 'error'"), ("props", "value >= 20")]


def gappy_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("value") >= 20, F.col("props")).alias("props"))


@query("high_missing_columns", """
    SELECT name, pct AS missing_pct, CASE WHEN pct > 0 THEN CAST(pct AS VARCHAR) || '%' ELSE '—' END AS missing_text,
           pct > 20 AS high_missing
    FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS name,
              unnest([0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
              ROUND(COUNT(*) FILTER (event_type = 'error') * 100 / COUNT(*), 2),
              ROUND(COUNT(*) FILTER (NOT value >= 20) * 100 / COUNT(*), 2)]) AS pct FROM events)""")
def high_missing_columns(spark, sf_dir):
    profiled = profile.profile_columns(gappy_events(spark, sf_dir), ["event_id"])
    return profile.missing_warnings(profiled).select("name", "missing_pct", "missing_text", "high_missing")


_KEYED_COLUMNS = [("event_id", "int"), ("ts", "date"), ("user_id", "int"), ("event_type", "text"), ("value", "float"), ("props", "text")]


def keyed_profile_sql() -> str:
    """DuckDB text of the profiles of ``keyed_events``, samples as a list."""
    parts = []
    for i, (name, kind) in enumerate(_KEYED_COLUMNS):
        raw = {"int": "CASE WHEN missing > 0 THEN 'float64' ELSE 'int64' END", "float": "'float64'"}.get(kind, "'object'")
        detected = {"date": "'date'", "text": "CASE WHEN u <= 100 OR u <= n * 0.5 THEN 'categorical' ELSE 'text' END"}.get(
            kind, "CASE WHEN u <= 5 THEN 'categorical' ELSE 'numeric' END")
        parts.append(f"""
            SELECT upload_id, CAST({i} AS INTEGER) AS position, '{name}' AS name, {raw} AS raw_dtype, {detected} AS detected_type, n, missing, u,
                   (list({name} ORDER BY at_row) FILTER ({name} IS NOT NULL))[1:5] AS samples
            FROM keyed_events JOIN (SELECT upload_id, COUNT(*) AS n, COUNT(*) - COUNT({name}) AS missing, COUNT(DISTINCT {name}) AS u
                 FROM keyed_events GROUP BY upload_id) USING (upload_id) GROUP BY upload_id, n, missing, u""")
    return f"""
        SELECT upload_id, position, name, raw_dtype, detected_type,
               CASE detected_type WHEN 'date' THEN 'date' WHEN 'numeric' THEN 'measure' ELSE 'dimension' END AS suggested_role,
               missing AS missing_count, ROUND(missing * 100 / n, 2) AS missing_pct, u AS unique_count, n, COALESCE(samples, []) AS samples
        FROM ({' UNION ALL '.join(parts)})"""


def keyed_events(spark, sf_dir):
    """(rows, columns) of the events as 150 uploads, as a keyed scan gives them."""
    names = [n for n, _ in _KEYED_COLUMNS]
    rows = table(spark, sf_dir, "keyed_events").select("upload_id", F.col("at_row").alias("row"), F.array(*names).alias("values"))
    columns = rows.select("upload_id").distinct().withColumn("columns", F.array(*[F.lit(n) for n in names]))
    return rows, columns


@query("profile_uploads", f"""
    SELECT upload_id, position, name, raw_dtype, detected_type, suggested_role, missing_count, missing_pct, unique_count,
           array_to_string(samples, ' | ') AS samples FROM ({keyed_profile_sql()})""")
def profile_uploads(spark, sf_dir):
    """Column profiles of 150 uploads from the same folds."""
    return shown(keyed_profile.profile_uploads(*keyed_events(spark, sf_dir)))


@query("profile_digest", f"""
    SELECT upload_id, string_agg('  - ''' || name || ''': ' || detected_type || ', role=' || suggested_role || CASE WHEN len(samples) > 0
           THEN ', e.g. [' || array_to_string(list_transform(samples[1:2], lambda v: CASE WHEN raw_dtype = 'object' THEN '''' || v || '''' ELSE v END), ', ')
                || ']' ELSE '' END, chr(10) ORDER BY position) AS digest
    FROM ({keyed_profile_sql()}) GROUP BY upload_id""")
def profile_digest(spark, sf_dir):
    """The digest of every upload."""
    return profile.digest(keyed_profile.profile_uploads(*keyed_events(spark, sf_dir)), ["upload_id"])


@query("staging_registry", f"""
    SELECT 'client_' || CAST(upload_id % 7 AS VARCHAR) AS client_id, upload_id, 'staging_' || CAST(upload_id AS VARCHAR) AS table_name,
           MAX(n) AS row_count, 6 AS column_count, MAX(copies) AS duplicate_row_count, 'event_id' AS first_column,
           MAX(detected_type) FILTER (position = 0) AS first_type, MAX(unique_count) FILTER (position = 5) AS last_unique
    FROM ({keyed_profile_sql()}) JOIN (SELECT upload_id, COUNT(*) - COUNT(DISTINCT event_id) AS copies FROM keyed_events GROUP BY upload_id)
         USING (upload_id) GROUP BY upload_id""")
def staging_registry(spark, sf_dir):
    """The registry rows of 150 uploads, written by upload and read back."""
    path = scratch_path(spark, "registry")
    rows, columns = keyed_events(spark, sf_dir)
    counts = keyed_profile.value_counts(rows)
    types = keyed_profile.column_types(counts)
    clients = columns.select("upload_id", F.concat(F.lit("client_"), (F.col("upload_id") % 7).cast("string")).alias("client_id"))
    staging.stage_many(keyed_profile.registry(
        keyed_profile.profile_uploads(rows, columns, counts, types),
        keyed_profile.duplicate_counts(keyed_profile.typed_rows(rows, types)), clients), path)
    parsed = F.from_json("profile_data", "ARRAY<STRUCT<name: STRING, detected_type: STRING, unique_count: BIGINT>>")
    return spark.read.parquet(path).withColumn("p", parsed).select(
        "client_id", F.col("upload_id").cast("bigint").alias("upload_id"), "table_name", "row_count", "column_count", "duplicate_row_count",
        F.get("p", F.lit(0))["name"].alias("first_column"),
        F.get("p", F.lit(0))["detected_type"].alias("first_type"),
        F.element_at("p", -1)["unique_count"].alias("last_unique"))


def with_repeats(frame: DataFrame, condition: str) -> DataFrame:
    """The whole table, with the rows that meet the condition coming twice more."""
    again = frame.where(condition)
    return frame.unionByName(again).unionByName(again)


@query("duplicate_rows", """
    SELECT COUNT(*) + 2 * COUNT(*) FILTER (p_size % 3 = 0) AS row_count,
           2 * COUNT(*) FILTER (p_size % 3 = 0) AS duplicate_row_count
    FROM part""")
def duplicate_rows(spark, sf_dir):
    return profile.duplicate_counts(with_repeats(table(spark, sf_dir, "part"), "p_size % 3 = 0"))


@query("duplicate_line_items", """
    WITH t AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 2
               UNION ALL SELECT * FROM lineitem WHERE l_linenumber = 2)
    SELECT COUNT(*) AS row_count, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_row_count FROM t""")
def duplicate_line_items(spark, sf_dir):
    return profile.duplicate_counts(with_repeats(table(spark, sf_dir, "lineitem"), "l_linenumber = 2"))


@query("first_samples", " UNION ALL ".join(f"""
    SELECT {i} AS position, string_agg(v, ' | ' ORDER BY event_id) AS samples FROM (
        SELECT event_id, CAST({c} AS VARCHAR) AS v FROM events
        WHERE {c} IS NOT NULL {'AND ' + w if w else ''} ORDER BY event_id LIMIT 5)"""
    for i, (c, w) in enumerate(_GAPPY)))
def first_samples(spark, sf_dir):
    """First values in file order, from files of very different sizes, which Spark reads largest first."""
    path = scratch_path(spark, "ordered")
    number = F.lpad(F.floor(F.sqrt(F.col("event_id") / 50)).cast("string"), 9, "0")
    gappy_events(spark, sf_dir).withColumn("part", number).repartition("part").sortWithinPartitions("part", "event_id") \
        .write.partitionBy("part").parquet(path)
    firsts = profile.first_values(spark.read.parquet(path).drop("part"))
    return firsts.select("position", F.array_join("sample_values", " | ").alias("samples"))


@query("role_overrides", """
    SELECT name, suggested_role, COALESCE(given, suggested_role) AS role FROM (
        SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name,
               unnest([CASE WHEN COUNT(DISTINCT p_partkey) <= 5 THEN 'dimension' ELSE 'measure' END, 'dimension', 'dimension', 'dimension',
                       CASE WHEN COUNT(DISTINCT p_size) <= 5 THEN 'dimension' ELSE 'measure' END,
                       CASE WHEN COUNT(DISTINCT p_retailprice) <= 5 THEN 'dimension' ELSE 'measure' END]) AS suggested_role,
               unnest(['ignore', NULL, NULL, NULL, 'dimension', NULL]) AS given FROM part)""")
def role_overrides(spark, sf_dir):
    profiled = profile.profile_columns(table(spark, sf_dir, "part"), ["p_partkey"])
    return profile.with_role_overrides(profiled, {"p_partkey": "ignore", "p_size": "dimension"}) \
        .select("name", "suggested_role", "role")


@query("role_filtered_columns", "SELECT p_name, p_brand, p_retailprice FROM part")
def role_filtered_columns(spark, sf_dir):
    return profile.without_ignored(
        table(spark, sf_dir, "part"),
        {"p_partkey": "ignore", "p_type": "ignore", "p_size": "ignore", "p_brand": "dimension"})


@query("upload_profile_status", """
    SELECT u.upload_id, CASE WHEN status IN ('pending', 'profiling') THEN 'Profiling still in progress.'
                WHEN status = 'failed' THEN 'Profiling failed: ' || error_message
                WHEN s.profile_data IS NULL THEN 'Profile data not found.' END AS message,
           CASE WHEN status = 'profiled' THEN s.profile_data END AS profile_data
    FROM uploads u LEFT JOIN staging s ON s.upload_id = u.upload_id""")
def upload_profile_status(spark, sf_dir):
    answers = profile.upload_profiles(table(spark, sf_dir, "uploads"), table(spark, sf_dir, "staging"))
    return answers.select("upload_id", "message", "profile_data")
