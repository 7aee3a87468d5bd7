"""Profiles of many uploads at once: every count carries the upload it belongs to.

Input are rows (upload_id, row, values) with texts by column position, and the columns of each upload. Values are
counted per (upload, position, value) in one shuffle; types, missing and distinct counts are folds of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kpiloom.functions.dates import DATE_FORMATS, DATE_NAME_HINT, LONGEST_DATE, parses
from kpiloom.operators.profile import DATE_SAMPLE, SAMPLES, classified
from kpiloom.sources.delimited import _BOOLEAN_WORDS, _NUMBER, _WHOLE

_OPENING = 1024  # rows of an upload in which the first values of most columns are found
_LONG_TEXT = 64
_KEY = ["upload_id", "position"]
_RAW = {"long": "int64", "double": "float64", "boolean": "bool", "text": "object"}


def cells(rows: DataFrame) -> DataFrame:
    return rows.select("upload_id", "row", F.posexplode("values").alias("position", "value"))


def value_counts(rows: DataFrame) -> DataFrame:
    """(upload_id, position, value, n, n_open): how often a value comes, and how often in the opening. A long text that
    is no number is counted by its SHA-256. One row per value leaves a task."""
    value = F.when((F.length("value") > _LONG_TEXT) & ~F.col("value").rlike(_NUMBER),
                   F.concat(F.lit("sha256:"), F.sha2("value", 256))).otherwise(F.col("value"))
    return cells(rows).select("upload_id", "position", value.alias("value"), "row").groupBy(*_KEY, "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("row") < _OPENING).alias("n_open"))


def column_types(counts: DataFrame) -> DataFrame:
    """(upload_id, position, kind, held, opened): long, double, boolean or text by all values of the column; a column
    without any is double, whole numbers that no long holds stay text."""
    v, n = F.col("value"), F.col("n")

    def of(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0))

    whole = v.rlike(_WHOLE)
    seen = counts.groupBy(*_KEY).agg(
        of(v.isNotNull()).alias("held"), of(whole).alias("w"),
        of(F.when(whole, F.trim(v).try_cast("bigint").isNotNull())).alias("l"), of(v.rlike(_NUMBER)).alias("d"),
        of(v.isin(_BOOLEAN_WORDS)).alias("b"), F.sum(F.when(v.isNotNull(), F.col("n_open")).otherwise(0)).alias("opened"))
    held = F.col("held")
    kind = (F.when(held == 0, "double").when(F.col("b") == held, "boolean").when(F.col("l") == held, "long")
            .when(F.col("w") == held, "text").when(F.col("d") == held, "double").otherwise("text"))
    return seen.select(*_KEY, kind.alias("kind"), "held", "opened")


def typed(value: Column, kind: Column) -> Column:
    """The value as text of its column's type, so that equal numbers are equal texts."""
    number = F.trim(value).try_cast("double")
    return (F.when(kind == "long", F.trim(value).try_cast("bigint").cast("string"))
            .when(kind == "double", F.when(~F.isnan(number), number + F.lit(0.0)).cast("string"))
            .when(kind == "boolean", F.lower(value)).otherwise(value))


def typed_rows(rows: DataFrame, types: DataFrame) -> DataFrame:
    """``rows`` with every value in its column's type."""
    kinds = types.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("position", "kind"))).alias("kinds"))
    return rows.join(kinds, "upload_id").select("upload_id", "row", F.zip_with(
        "values", "kinds", lambda v, k: typed(v, k["kind"])).alias("values"))


def _first_values(rows: DataFrame, types: DataFrame) -> DataFrame:
    """(upload_id, position, sample_values, sampled, sampled_dates) from the first values of every column by row
    number. Columns with too few in an upload's opening are read whole; the others only there."""
    short = types.where((F.col("opened") < DATE_SAMPLE) & (F.col("held") > F.col("opened"))).select(*_KEY)
    found = cells(rows.where(F.col("row") < _OPENING)).unionByName(
        cells(rows.where(F.col("row") >= _OPENING)).join(short, _KEY, "left_semi")).where("value IS NOT NULL")
    rank = F.row_number().over(W.partitionBy(*_KEY).orderBy("row"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= DATE_SAMPLE)
    shown = first.join(types.select(*_KEY, "kind"), _KEY).select(
        *_KEY, "rank", F.when(F.col("rank") <= SAMPLES, typed(F.col("value"), F.col("kind"))).alias("sample"),
        F.when(F.col("kind") == "text", F.when(F.length(F.trim("value")) > LONGEST_DATE, "-").otherwise(F.trim("value"))).alias("date"))
    fitting = [F.count_if(parses(F.col("date"), p)) for p in DATE_FORMATS]
    samples = F.sort_array(F.collect_list(F.when(F.col("rank") <= SAMPLES, F.struct("rank", "sample"))))
    return shown.groupBy(*_KEY).agg(
        F.transform(samples, lambda s: s["sample"]).alias("sample_values"), F.count("date").alias("sampled"),
        F.greatest(*fitting).alias("sampled_dates"))


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """(upload_id, row_count, duplicate_row_count) from typed rows: 16 bytes a row are shuffled, and rows whose
    fingerprint repeats are compared in full."""
    values = F.transform("values", lambda v: F.coalesce(v, F.lit("\u0000")))
    marked = rows.select("upload_id", "values", F.xxhash64(values).alias("h1"), F.xxhash64(F.lit("second"), values).alias("h2"))
    groups = marked.groupBy("upload_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    again = groups.where("n > 1").select("upload_id", "h1", "h2")
    compared = marked.join(again, ["upload_id", "h1", "h2"], "left_semi").select("upload_id", "values").distinct()
    parts = groups.groupBy("upload_id").agg(
        F.sum("n").alias("row_count"), (F.sum("n") - F.count_if(F.col("n") == 1)).alias("of_repeated")).unionByName(
        compared.groupBy("upload_id").agg(F.count(F.lit(1)).alias("distinct")), allowMissingColumns=True)
    return parts.groupBy("upload_id").agg(
        F.max("row_count").alias("row_count"),
        (F.coalesce(F.max("of_repeated"), F.lit(0)) - F.coalesce(F.max("distinct"), F.lit(0))).alias("duplicate_row_count"))


def profile_uploads(rows: DataFrame, columns: DataFrame, counts: DataFrame | None = None,
                    types: DataFrame | None = None) -> DataFrame:
    """One row per upload and column: what ``profile_columns`` says of a single table, in file order.

    ``rows`` (upload_id, row, values) hold texts with nulls for missing values, ``columns`` (upload_id, columns) the
    names. An upload without rows has its columns with nothing in them.
    """
    counts = value_counts(rows) if counts is None else counts
    types = column_types(counts) if types is None else types
    names = columns.select("upload_id", F.posexplode("columns").alias("position", "name")).withColumn(
        "hinted", F.col("name").rlike(DATE_NAME_HINT))
    kinds = names.join(types.select(*_KEY, "kind"), _KEY, "left").withColumn("kind", F.coalesce("kind", F.lit("double")))
    is_text = F.col("kind").isin("text", "boolean")
    keyed = counts.join(kinds.select(*_KEY, "kind", "hinted"), _KEY).select(
        *_KEY, "n", "hinted", is_text.alias("is_text"), typed(F.col("value"), F.col("kind")).alias("value"))
    values = keyed.groupBy(*_KEY, "hinted", "is_text", "value").agg(F.sum("n").alias("n"))
    asked = F.col("hinted") & F.col("is_text")
    rates = [F.sum(F.when(asked & parses(F.col("value"), p), F.col("n")).otherwise(0)) for p in DATE_FORMATS]
    facts = values.groupBy(*_KEY).agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing_count"),
        F.count("value").alias("unique_count"), F.greatest(*rates).alias("parsed"))
    raw = F.create_map(*[F.lit(x) for pair in _RAW.items() for x in pair])
    joined = kinds.withColumns({"dtype": raw[F.col("kind")], "is_text": is_text}).join(facts, _KEY, "left").join(
        _first_values(rows, types), _KEY, "left")
    sampled = F.when((F.col("kind") == "text") & ~F.col("hinted"), F.col("sampled"))
    return classified(joined.withColumn("sampled", sampled), ["upload_id"])


def registry(profile: DataFrame, counts: DataFrame, uploads: DataFrame) -> DataFrame:
    """One registry row per profiled upload; ``uploads`` has (upload_id, client_id)."""
    described = profile.groupBy("upload_id").agg(
        F.count(F.lit(1)).cast("int").alias("column_count"),
        F.to_json(F.transform(
            F.sort_array(F.collect_list(F.struct(
                "position", "name", "raw_dtype", "detected_type", "suggested_role",
                "missing_count", "missing_pct", "unique_count", "sample_values"))),
            lambda c: c.dropFields("position"))).alias("profile_data"))
    zero = F.lit(0).cast("bigint")
    return uploads.select("upload_id", "client_id").join(described, "upload_id").join(counts, "upload_id", "left").select(
        "client_id", "upload_id", F.concat(F.lit("staging_"), F.col("upload_id").cast("string")).alias("table_name"),
        F.coalesce("row_count", zero).alias("row_count"), "column_count",
        F.coalesce("duplicate_row_count", zero).alias("duplicate_row_count"), "profile_data")
