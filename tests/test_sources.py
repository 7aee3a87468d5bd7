import datetime as dt

import pytest
from pyspark.sql import functions as F

from kpiloom.sources import delimited, sinks, staging, uploads
from kpiloom.streaming import refresh as stream


def test_scan_types_and_null_tokens(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text('Id,Amount,Flag,Note,Empty,Big\n1,1.5,True,"a ""quoted"", line\nbreak",,1\n2,n/a,False,NULL,NA,99999999999999999999\n3,2,True, x ,,2\n')
    df = delimited.scan_delimited(spark, str(path))
    assert dict(df.dtypes) == {"Id": "bigint", "Amount": "double", "Flag": "boolean", "Note": "string", "Empty": "double", "Big": "string"}
    rows = df.orderBy("Id").collect()
    assert rows[0]["Note"] == 'a "quoted", line\nbreak' and rows[1]["Note"] is None and rows[2]["Note"] == " x "
    assert [r["Amount"] for r in rows] == [1.5, None, 2.0] and rows[0]["Empty"] is None


def test_repeated_headers_can_be_scanned(spark, tmp_path):
    path = tmp_path / "twice.csv"
    path.write_text("a b,a-b,x.y\n1,2,3\n")
    df = delimited.with_normalised_headers(delimited.scan_delimited(spark, str(path)))
    assert df.columns == ["a_b", "a_b_1", "x_y"] and df.first()["x_y"] == 3


def test_admission_order_and_limits(spark):
    files = spark.createDataFrame([("a.csv", 52428800), ("a.csv", 52428801), ("A.XLSX", 1), ("a.txt", 99999999), ("a", 1)],
                                  "filename string, size_bytes bigint")
    assert [r["reason"] for r in uploads.admit(files).collect()] == [
        None, "File exceeds 50MB limit.", None, "Unsupported file type '.txt'. Upload .xlsx or .csv.",
        "Unsupported file type ''. Upload .xlsx or .csv."]
    assert [r["accepted"] for r in uploads.admit(files, max_bytes=None).collect()] == [True, True, True, False, False]


def test_listing_does_not_read_contents(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a\n1\n")
    files = uploads.list_files(spark, str(tmp_path))
    assert [(r["filename"], r["size_bytes"]) for r in files.collect()] == [("one.csv", 4)]
    schema = files._jdf.queryExecution().toString().rsplit("ReadSchema: ", 1)[-1]
    assert "content" not in schema


def test_restaging_replaces_one_upload(spark, tmp_path):
    first = spark.createDataFrame([(1, "a"), (2, "b")], "upload_id int, v string")
    staging.stage_many(first, str(tmp_path / "t"))
    staging.stage_many(spark.createDataFrame([(2, "c")], "upload_id int, v string"), str(tmp_path / "t"))
    got = {(r["upload_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()}
    assert got == {(1, "a"), (2, "c")}


def test_tenant_layout_prunes(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "concat('c', id % 3) AS client_id", "id % 2 AS dataset_id")
    uploads.write_tenant_layout(df, str(tmp_path / "t"))
    one = uploads.of_tenant(spark.read.parquet(str(tmp_path / "t")), "c1")
    assert one.count() == 33
    assert "PartitionFilters: [isnotnull(client_id" in one._jdf.queryExecution().toString()


def test_log_and_documents(spark, tmp_path):
    steps = spark.createDataFrame([("r", "x", 5)], "request_id string, kind string, ms int")
    rows = sinks.log_rows(steps, "compute", F.struct("kind"), F.col("kind"), F.col("ms"))
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len(back) == 2 and back[0]["input"] == '{"kind":"x"}' and back[0]["output"] == "x" and back[0]["latency_ms"] == 5
    sinks.write_documents(spark.createDataFrame([('{"a":1}',)], "document string"), str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first()["a"] == 1


def put(folder, upload_id, name, text):
    (folder / str(upload_id)).mkdir(parents=True, exist_ok=True)
    (folder / str(upload_id) / name).write_bytes(text if isinstance(text, bytes) else text.encode())


def test_uploads_fail_alone_and_can_run_again(spark, tmp_path):
    from kpiloom.sources import ingest

    root, folder = str(tmp_path / "root"), tmp_path / "in"
    for i in range(3):
        put(folder, i, "u.csv", "Day,Total %,Note\n" + "".join(
            f"2024-01-{d:02d},{d * i},n{d}\n" for d in range(1, 11)) + f"2024-01-01,{i}.0,n1\n")
    put(folder, 7, "book.xlsx", "a,b\n1,2\n")
    put(folder, 8, "ragged.csv", "a,b\n1,2,3\n")
    put(folder, 10, "open.csv", 'a,b\n1,"2\n')
    put(folder, 11, "latin.csv", b"a,b\n1,\xe9\n")
    put(folder, 12, "empty.csv", "")
    put(folder, 13, "header.csv", "a,b\n")
    put(folder, 99, "other.csv", "a,b\n1,2\n")  # nobody asks for this one
    pending = spark.createDataFrame([(i, "c") for i in (0, 1, 2, 7, 8, 9, 10, 11, 12, 13)], "upload_id bigint, client_id string")
    for _ in range(2):
        outcome = {r["upload_id"]: r["error_message"] for r in ingest.ingest_uploads(spark, pending, str(folder), root).collect()}
        assert len(outcome) == 10 and [outcome[i] for i in (0, 1, 2, 13)] == [None] * 4 and outcome[9].endswith("/9")
        assert outcome[7] == "Unsupported file type '.xlsx'. Upload .csv."
        assert "more fields than the header" in outcome[8] and "quote" in outcome[10]
        assert "UTF-8" in outcome[11] and outcome[12].startswith("No file with content")
    rows = {r["upload_id"]: r for r in spark.read.parquet(f"{root}/registry").collect()}
    assert set(rows) == {0, 1, 2, 13}
    assert all(rows[i]["row_count"] == 11 and rows[i]["column_count"] == 3 for i in range(3))
    assert [rows[i]["duplicate_row_count"] for i in (0, 1, 2)] == [1, 1, 1] and rows[13]["row_count"] == 0
    staged = ingest.staged_upload(spark, root, 2)
    assert staged.dtypes == [("day", "string"), ("total", "double"), ("note", "string")]
    assert [r["total"] for r in staged.collect()] == [2.0 * d for d in range(1, 11)] + [2.0]


def test_keyed_scan_equals_single_scans(spark, tmp_path):
    """Quotes, line breaks, missing fields and words, repeated and differing headers, several files: the profile and the
    rows of uploads taken in together are those of each scanned alone."""
    from kpiloom.operators.profile import duplicate_counts, profile_columns
    from kpiloom.sources import ingest

    folder, root = tmp_path / "in", str(tmp_path / "root")
    put(folder, 1, "a.csv", 'Id,Amount,Flag,Note,Empty,Big,Date\r\n1,1.5,True,"a ""quoted"", line\nbreak",,1,2024-01-01\r\n'
        '2,n/a,False,NULL,NA,99999999999999999999,2024-02-01\r\n\r\n3,2,True, x ,,2,\r\n3,2.0,true, x ,,2,\r\n')
    put(folder, 2, "a.csv", "a b,a-b,x.y\n1,2,3\n4,5\n")
    put(folder, 3, "1.csv", "k,v\n" + "".join(f"{i},{i % 7}/03/2024\n" for i in range(2000)))
    put(folder, 3, "2.csv", "v,k,extra\n01/03/2024,5000,late\n")
    put(folder, 4, "x.csv", "late\n" + "\n" * 3 + "".join("NA\n" for _ in range(3000)) + "first\nsecond\n")
    pending = spark.createDataFrame([(i, "c") for i in (1, 2, 3, 4)], "upload_id bigint, client_id string")
    assert all(r["error_message"] is None for r in ingest.ingest_uploads(spark, pending, str(folder), root).collect())
    registry = {r["upload_id"]: r for r in spark.read.parquet(f"{root}/registry").collect()}
    for i in (1, 2, 3, 4):
        names = sorted(str(p) for p in (folder / str(i)).iterdir())
        alone = delimited.with_normalised_headers(delimited.scan_delimited(spark, names))
        together = ingest.staged_upload(spark, root, i)
        assert together.dtypes == alone.dtypes
        assert sorted(map(repr, together.collect())) == sorted(map(repr, alone.collect()))
        want = [r.asDict() for r in profile_columns(together.withColumn("at", F.monotonically_increasing_id()), ["at"])
                .where("name <> 'at'").orderBy("position").collect()]
        got = spark.createDataFrame([(registry[i]["profile_data"],)], "p string").select(F.from_json(
            "p", "array<struct<name:string,raw_dtype:string,detected_type:string,suggested_role:string,missing_count:bigint,"
                 "missing_pct:double,unique_count:bigint,sample_values:array<string>>>").alias("p")).first()["p"]
        assert [r.asDict() for r in got] == [{k: v for k, v in r.items() if k != "position"} for r in want], i
        counts = duplicate_counts(alone).first()
        assert (registry[i]["row_count"], registry[i]["duplicate_row_count"]) == tuple(counts)


def test_ordinals_and_first_values_follow_the_files(spark, tmp_path):
    """Large and small files, which Spark reads largest first: samples and numbers go by name and place."""
    from kpiloom.operators.profile import first_values
    from kpiloom.sources.order import with_ordinals

    want = []
    for i, n in enumerate((1, 4000, 3, 20_000, 2)):
        rows = [(len(want) + k, None if len(want) + k < 4500 else f"t{len(want) + k}") for k in range(n)]
        want += rows
        part = spark.createDataFrame(rows, "id bigint, late string").coalesce(1)
        part.write.parquet(str(tmp_path / "p" / f"f{i}"))
        part.write.csv(str(tmp_path / "c" / f"f{i}"))
    parquet = spark.read.option("recursiveFileLookup", "true").schema("id bigint, late string").parquet(str(tmp_path / "p"))
    text = spark.read.option("recursiveFileLookup", "true").schema("id bigint, late string").csv(str(tmp_path / "c"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for frame, size in ((parquet, old), (text, old), (text, "20k")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            numbered = with_ordinals(frame)
            assert numbered.where("row <> id").count() == 0 and numbered.count() == len(want)
            firsts = {r["position"]: r["sample_values"] for r in first_values(frame).collect()}
            assert firsts == {0: ["0", "1", "2", "3", "4"], 1: [f"t{4500 + k}" for k in range(5)]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_without_a_needed_column_are_flagged(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS kind, 1.0D AS value").write.parquet(source)
    spark.sql("SELECT 'b' AS kind").write.mode("append").parquet(source)
    incoming = spark.readStream.schema("kind string, value double").parquet(source)
    stream.refresh(spark, incoming, [F.col("kind")], ["value"], str(tmp_path / "s"), str(tmp_path / "c"), str(tmp_path / "f"))
    assert [r["flag"] for r in spark.read.parquet(str(tmp_path / "f")).collect()] == ["column 'value' missing"]
    totals = stream.current_totals(spark, str(tmp_path / "s"), ["kind"], ["value"])
    assert {r["kind"]: r["value"] for r in totals.collect()} == {"a": 1.0, "b": 0.0}


def test_stream_equals_batch_over_all_files(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "sums", "mark"))
    rows = [(dt.datetime(2024, 1, 1 + i % 20), "ab"[i % 2], round(i * 0.37, 2)) for i in range(200)]
    events = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, value double")
    keys = [F.date_trunc("week", "ts").alias("period"), F.col("kind")]

    def run():
        incoming = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.refresh(spark, incoming, keys, ["value"], target, mark)
        return {(r["period"], r["kind"]): (r["rows"], r["value"])
                for r in stream.current_totals(spark, target, ["period", "kind"], ["value"]).collect()}

    def batch(df):
        got = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(20,6)")).cast("double").alias("v"))
        return {(r["period"], r["kind"]): (r["n"], r["v"]) for r in got.collect()}

    early, late = events.where("ts < timestamp_ntz'2024-01-08'"), events.where("ts >= timestamp_ntz'2024-01-08'")
    early.repartition(3).write.parquet(source)
    assert run() == batch(early)
    late.repartition(2).write.mode("append").parquet(source)
    assert run() == batch(events)
    assert run() == batch(events)
    stream.compact(spark, target, ["period", "kind"], ["value"])
    assert run() == batch(events)
    early.write.mode("append").parquet(source)
    assert run() == batch(events.unionByName(early))
    stream.compact(spark, target, ["period", "kind"], ["value"])
    assert run() == batch(events.unionByName(early))


def test_scratch_follows_the_session_setting(spark):
    from kpiloom.session import scratch_path

    root = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    if root:
        assert scratch_path(spark, "x").startswith(f"{root}/x-")


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_long_whole_numbers_keep_their_digits(spark, tmp_path):
    path = write(tmp_path, a="id,big\n1234567890123456789,12345678901234567890\n1234567890123456788,1\n")
    rows = delimited.scan_delimited(spark, path)
    assert dict(rows.dtypes) == {"id": "bigint", "big": "string"}
    assert sorted(r["id"] for r in rows.collect()) == [1234567890123456788, 1234567890123456789]
    assert {r["big"] for r in rows.collect()} == {"12345678901234567890", "1"}


def test_columns_of_several_files_align_by_name(spark, tmp_path):
    path = write(tmp_path, a="a,b\n1,2\n", b="b,a\n9,8\n", c="b\n5\n")
    rows = delimited.scan_delimited(spark, path).select("a", "b").collect()
    assert {(r["a"], r["b"]) for r in rows} == {(1, 2), (8, 9), (None, 5)}


def test_short_rows_end_in_nulls_and_long_rows_fail(spark, tmp_path):
    (tmp_path / "s").mkdir(), (tmp_path / "l").mkdir()
    short = write(tmp_path / "s", a="a,b\n1\n3,4\n")
    assert {(r["a"], r["b"]) for r in delimited.scan_delimited(spark, short).collect()} == {(1, None), (3, 4)}
    long = write(tmp_path / "l", a="a,b\n3,4,5\n")
    with pytest.raises(Exception, match="more fields than the header"):
        delimited.scan_delimited(spark, long).collect()
    assert delimited.scan_delimited(spark, long, long_rows="cut").collect() == [(3, 4)]


def test_stream_keeps_long_sums(spark, tmp_path):
    source = str(tmp_path / "in")
    big = 2**53
    spark.createDataFrame([("k", big + 1), ("k", big + 3), ("k", -1)], "key string, n long").write.parquet(source)
    events = spark.readStream.schema("key string, n long").parquet(source)
    stream.refresh(spark, events, [F.col("key")], ["n"], str(tmp_path / "sums"), str(tmp_path / "ck"))
    parts = spark.read.parquet(str(tmp_path / "sums"))
    got = parts.select(((F.col("n__high") * F.lit(1 << 40)) + F.col("n__mid") * F.lit(1 << 20) + F.col("n__low")).alias("n"))
    assert sum(r["n"] for r in got.collect()) == 2 * big + 3


def test_snapshot_swap_survives_a_failure(spark, tmp_path, monkeypatch):
    """A run that dies between writing a snapshot and naming it changes nothing; the next one goes on."""
    from kpiloom.sources import snapshots

    root = str(tmp_path / "s")
    with pytest.raises(ValueError):
        snapshots.current(spark, root)
    assert snapshots.publish(spark.range(3).selectExpr("id", "'a' AS v"), root) == 1
    pinned = snapshots.current(spark, root)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_name", dies)
        with pytest.raises(RuntimeError):
            snapshots.publish(spark.range(9).selectExpr("id", "'b' AS v"), root)
    assert {(r["id"], r["v"]) for r in snapshots.current(spark, root).collect()} == {(0, "a"), (1, "a"), (2, "a")}
    # made from the snapshot it replaces
    assert snapshots.publish(snapshots.current(spark, root).where("id > 0").selectExpr("id", "'c' AS v"), root) == 2
    assert {(r["id"], r["v"]) for r in snapshots.current(spark, root).collect()} == {(1, "c"), (2, "c")}
    assert pinned.count() == 3 and snapshots.current(spark, root, version=1).count() == 3
    assert snapshots.versions(spark, root).count() == 2
