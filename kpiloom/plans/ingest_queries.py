"""Scans, admission, staging, registry, and the refresh stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from kpiloom.functions.text import extension, stem
from kpiloom.operators.kpi import ColumnMapping, KpiDef
from kpiloom.plans.registry import query
from kpiloom.plans.tables import table
from kpiloom.session import scratch_path
from kpiloom.sources import delimited, ingest, staging, uploads
from kpiloom.operators.profile import profile_columns
from kpiloom.streaming import profile as profile_stream
from kpiloom.streaming import refresh as stream


def written_csv(spark, df, name: str) -> str:
    path = scratch_path(spark, name)
    df.write.csv(path, header=True, escape='"', quoteAll=False, emptyValue="",
                 ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("delimited_scan", """
    SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS total_price,
           CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status, o_custkey % 2 = 0 AS even,
           o_orderpriority AS status_1, CAST(NULL AS DOUBLE) AS nothing FROM orders""")
def delimited_scan(spark, sf_dir):
    """Orders as a delimited file with missing-value words, scanned, typed and renamed."""
    key = F.col("o_orderkey")
    source = table(spark, sf_dir, "orders").select(
        key.alias(" Order Key "),
        F.when(key % 4 == 0, F.when(key % 8 == 0, "NaN").otherwise("n/a"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("Total-Price"),
        F.when(key % 5 == 0, "NULL").otherwise(F.col("o_orderstatus")).alias("Status"),
        F.when(F.col("o_custkey") % 2 == 0, "True").otherwise("False").alias("Even?"),
        F.col("o_orderpriority").alias("Status%"), F.lit("NA").alias("nothing"))
    path = written_csv(spark, source, "delimited")
    return delimited.with_normalised_headers(delimited.scan_delimited(spark, path))


@query("delimited_texts", """
    SELECT doc_id, text, lang, source, n_chars FROM documents""")
def delimited_texts(spark, sf_dir):
    """Whole texts with quotes and line breaks through a delimited file."""
    path = written_csv(spark, table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", "source", "n_chars"), "texts")
    return delimited.scan_delimited(spark, path)


@query("normalised_headers", """
    SELECT p_partkey AS part_key, p_name AS part_key_1, p_brand AS ptp, p_size AS café, p_type AS "column" FROM part""")
def normalised_headers(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias(" Part Key "), F.col("p_name").alias("Part-Key"),
        F.col("p_brand").alias("PTP %"), F.col("p_size").alias("Café"), F.col("p_type").alias("###"))
    return delimited.with_normalised_headers(part)


@query("upload_admission", """
    SELECT upload_id, ext AS extension, reason IS NULL AS accepted, reason FROM (
        SELECT upload_id, ext, CASE WHEN ext NOT IN ('.xlsx', '.csv') THEN 'Unsupported file type ''' || ext || '''. Upload .xlsx or .csv.'
                    WHEN size_bytes > 52428800 THEN 'File exceeds 50MB limit.' END AS reason
        FROM (SELECT upload_id, size_bytes, CASE WHEN contains(filename, '.')
                     THEN '.' || lower(string_split(filename, '.')[-1]) ELSE '' END AS ext FROM uploads))""")
def upload_admission(spark, sf_dir):
    return uploads.admit(table(spark, sf_dir, "uploads")).select("upload_id", "extension", "accepted", "reason")


@query("file_names", """
    SELECT upload_id, CASE WHEN contains(filename, '.') THEN regexp_replace(filename, '\\.[^.]*$', '') ELSE filename END AS stem,
           CASE WHEN contains(filename, '.') THEN '.' || lower(string_split(filename, '.')[-1]) ELSE '' END AS extension,
           client_id || '/' || CAST(dataset_id AS STRING) || '/' || filename AS storage_key
    FROM uploads""")
def file_names(spark, sf_dir):
    return table(spark, sf_dir, "uploads").select(
        "upload_id", stem(F.col("filename")).alias("stem"), extension(F.col("filename")).alias("extension"),
        uploads.storage_key(F.col("client_id"), F.col("dataset_id"), F.col("filename")).alias("storage_key"))


@query("upload_outcomes", """
    SELECT u.upload_id, CASE WHEN u.status NOT IN ('pending', 'profiling') THEN u.status WHEN r.upload_id IS NULL THEN 'profiling'
                WHEN r.error_message IS NOT NULL THEN 'failed' ELSE 'profiled' END AS status,
           CASE WHEN u.status IN ('pending', 'profiling') THEN r.error_message ELSE u.error_message END AS error_message
    FROM uploads u LEFT JOIN parse_results r ON r.upload_id = u.upload_id""")
def upload_outcomes(spark, sf_dir):
    after = uploads.upload_outcomes(table(spark, sf_dir, "uploads"), table(spark, sf_dir, "parse_results"))
    return after.select("upload_id", "status", "error_message")


@query("tenant_partitions", """
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 7""")
def tenant_partitions(spark, sf_dir):
    """Customers in the tenant layout, one client read back."""
    path = scratch_path(spark, "tenants")
    keyed = table(spark, sf_dir, "customer").withColumns({
        "client_id": F.concat(F.lit("client_"), F.col("c_nationkey").cast("string")),
        "dataset_id": F.col("c_nationkey") + 100})
    uploads.write_tenant_layout(keyed, path)
    return uploads.of_tenant(spark.read.parquet(path), "client_7").select("c_custkey", "c_name", "c_acctbal")


@query("staged_table", """
    SELECT o_orderkey, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS upload_id
    FROM orders WHERE o_orderpriority <> '3-MEDIUM'
    UNION ALL SELECT o_orderkey, 0.0, 3 FROM orders WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F'""")
def staged_table(spark, sf_dir):
    """Many uploads staged, then one of them staged again."""
    path = scratch_path(spark, "staged")
    rows = table(spark, sf_dir, "orders").withColumn("upload_id", F.substring("o_orderpriority", 1, 1).cast("int")).select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "upload_id")
    staging.stage_many(rows, path)
    again = rows.where("upload_id = 3 AND o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    staging.stage_many(again, path)
    return spark.read.parquet(path).select("o_orderkey", "o_totalprice", "upload_id")


_HEADERS = {"o_orderkey": "Order Key", "o_custkey": "Customer", "o_orderstatus": "Order-Status", "o_totalprice": "Total %",
            "o_day": "Order Day", "o_orderpriority": "order status"}


def _kind(column: str) -> str:
    return f"CASE WHEN COUNT(DISTINCT {column}) <= 5 THEN 'categorical' ELSE 'numeric' END"


@query("ingested_uploads", f"""
    SELECT upload_id, CAST(NULL AS VARCHAR) AS outcome, COUNT(*) AS row_count, 6 AS column_count,
           COUNT(*) - COUNT(DISTINCT o_orderkey) AS duplicate_row_count,
           CASE WHEN upload_id % 2 = 0 THEN 'order_key:' || {_kind('o_orderkey')} || ',customer:' || {_kind('o_custkey')}
                || ',order_status:categorical,total:' || {_kind('o_totalprice')} || ',order_day:date,order_status_1:categorical'
                ELSE 'order_status:categorical,order_day:date,total:' || {_kind('o_totalprice')} || ',order_status_1:categorical,customer:'
                || {_kind('o_custkey')} || ',order_key:' || {_kind('o_orderkey')} END AS types,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS staged_total
    FROM uploaded GROUP BY upload_id
    UNION ALL SELECT unnest([1000, 1001]), 'failed', NULL, NULL, NULL, NULL, NULL FROM (SELECT COUNT(*) FROM orders)""")
def ingested_uploads(spark, sf_dir):
    """All orders as 120 delimited uploads of two layouts through the whole ingest, beside one of another type and one
    that is not there."""
    folder, root = scratch_path(spark, "uploads"), scratch_path(spark, "ingest")
    sent = table(spark, sf_dir, "uploaded")
    for half, names in ((0, list(_HEADERS)), (1, list(_HEADERS)[::-1])):
        part = sent.where(F.col("upload_id") % 2 == half).select(*[F.col(n).alias(_HEADERS[n]) for n in names], "upload_id")
        part.repartition("upload_id").write.partitionBy("upload_id").csv(f"{folder}/half_{half}", header=True, escape='"')
    note = spark.range(1000, 1001).select(F.col("id").alias("upload_id"), F.lit("a,b").alias("value"))
    note.write.partitionBy("upload_id").text(f"{folder}/notes")
    pending = sent.select("upload_id").distinct().union(spark.range(1000, 1002)).select(
        "upload_id", F.concat(F.lit("client_"), F.col("upload_id").cast("string")).alias("client_id"))
    outcomes = ingest.ingest_uploads(spark, pending, folder, root)
    parsed = F.from_json("profile_data", "ARRAY<STRUCT<name: STRING, detected_type: STRING>>")
    registry = spark.read.parquet(f"{root}/registry").select(
        F.col("upload_id").cast("bigint").alias("upload_id"), "row_count", "column_count", "duplicate_row_count",
        F.array_join(F.transform(parsed, lambda c: F.concat(c["name"], F.lit(":"), c["detected_type"])), ",").alias("types"))
    price = spark.read.parquet(f"{root}/columns").where("name = 'total'").select(
        F.col("upload_id").cast("bigint").alias("upload_id"), "position")
    staged = spark.read.parquet(f"{root}/staged").withColumn("upload_id", F.col("upload_id").cast("bigint"))
    totals = staged.join(price, "upload_id").groupBy("upload_id").agg(
        F.sum(F.get("values", F.col("position")).cast("decimal(18,2)")).cast("double").alias("staged_total"))
    return outcomes.select(F.col("upload_id").cast("bigint").alias("upload_id"), "error_message").join(
        registry, "upload_id", "left").join(totals, "upload_id", "left").select(
        "upload_id", F.when(F.col("error_message").isNotNull(), "failed").alias("outcome"),
        "row_count", "column_count", "duplicate_row_count", "types", "staged_total")


@query("row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS name, COUNT(*) AS row_count FROM {t}" for t in ("lineitem", "orders", "events", "documents")))
def row_counts(spark, sf_dir):
    frames = [
        table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("name"), "row_count")
        for t in ("lineitem", "orders", "events", "documents")]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


@query("refreshed_kpis", """
    SELECT event_type, 'event_value' AS kpi_id, ROUND(v, 4) AS value,
           CASE WHEN v > 30 THEN 'value ' || printf('%.4f', v) || ' above expected max 30' ELSE '' END AS flags, 0 AS missing_columns
    FROM (SELECT event_type, CAST(SUM(CAST(value AS DECIMAL(38,12))) AS DOUBLE) / SUM(user_id) AS v FROM events GROUP BY event_type)""")
def refreshed_kpis(spark, sf_dir):
    """A ratio KPI over the refreshed sums, and the check of the files taken in."""
    source = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{sf_dir}/events.parque[t]")
    root = scratch_path(spark, "refreshed")
    columns = ["value", "user_id"]
    stream.refresh(spark, events, [F.col("event_type")], columns, f"{root}/sums", f"{root}/checkpoint",
                   f"{root}/flags")
    kpis = stream.current_kpis(
        spark, f"{root}/sums", ["event_type"], columns, ["event_value"],
        {"event_value": KpiDef("event_value", "value", "user_id", max=30)},
        {"event_value": ColumnMapping(None, "value", "user_id")})
    gaps = spark.read.parquet(f"{root}/flags").count()
    return kpis.select("event_type", "kpi_id", "value", F.array_join("flags", " | ").alias("flags"),
                       F.lit(gaps).alias("missing_columns"))


@query("refresh_stream", """
    SELECT date_trunc('week', ts)::TIMESTAMP AS period, event_type, COUNT(*) AS rows,
           CAST(SUM(CAST(value AS DECIMAL(38,12))) AS DOUBLE) AS value
    FROM events GROUP BY ALL""")
def refresh_stream(spark, sf_dir):
    """The events files as a stream, folded into weekly sums."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A glob stands for one file as well as for a folder of files.
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    root = scratch_path(spark, "refresh")
    period = F.date_trunc("week", "ts").cast("timestamp_ntz").alias("period")
    stream.refresh(spark, events, [period, F.col("event_type")], ["value"], f"{root}/sums", f"{root}/checkpoint")
    return stream.current_totals(spark, f"{root}/sums", ["period", "event_type"], ["value"])


@query("refresh_in_batches", """
    SELECT event_type, COUNT(*) AS rows, CAST(SUM(CAST(value AS DECIMAL(38,12))) AS DOUBLE) AS value,
           CAST(SUM(user_id) AS DOUBLE) AS user_id
    FROM events GROUP BY event_type""")
def refresh_in_batches(spark, sf_dir):
    """The events as several files and batches: half of them, a fold of the batches, then the other half."""
    events = table(spark, sf_dir, "events")
    root = scratch_path(spark, "batches")
    columns = ["value", "user_id"]
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{root}/files")
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/files")
        stream.refresh(spark, arriving, [F.col("event_type")], columns, f"{root}/sums", f"{root}/checkpoint")
        if half == 0:
            stream.compact(spark, f"{root}/sums", ["event_type"], columns)
    return stream.current_totals(spark, f"{root}/sums", ["event_type"], columns)


_EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query("profile_refreshed", " UNION ALL ".join(f"""
    SELECT '{c}' AS "column", COUNT(*) AS total, COUNT(*) - COUNT({c}) AS missing_count, TRUE AS within_bound
    FROM (SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN value END AS value) FROM events)""" for c in _EVENT_COLUMNS))
def profile_refreshed(spark, sf_dir):
    """All events in files that come in two runs; the profile merged from the files' parts, against the exact one."""
    events = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    root = scratch_path(spark, "profile-parts")
    for half in (0, 1):
        events.where(F.col("event_id") % 2 == half).repartition(3).write.mode("append").parquet(f"{root}/files")
        arriving = spark.readStream.schema(events.schema).parquet(f"{root}/files")
        profile_stream.refresh_profile(arriving, f"{root}/parts", f"{root}/checkpoint")
    merged = profile_stream.merged_profile(spark.read.parquet(f"{root}/parts"))
    exact = profile_columns(events).select(F.col("name").alias("column"), "unique_count")
    off = F.abs(F.col("unique_estimate") - F.col("unique_count"))
    return merged.join(exact, "column").select(
        "column", "total", "missing_count",
        (off <= F.col("unique_count") * profile_stream.DISTINCT_ERROR).alias("within_bound"))
