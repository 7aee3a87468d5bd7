"""Column profile: counts, samples, type and role."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from kpiloom.functions.dates import DATE_FORMATS, DATE_NAME_HINT, LONGEST_DATE, parses
from kpiloom.functions.frames import literal_rows
from kpiloom.functions.numbers import is_numeric, present
from kpiloom.sources.delimited import quoted
from kpiloom.sources.order import FILE, first_files, in_file_order

# Fixed values of the classifier.
NUMERIC_CATEGORY_MAX = 5
CATEGORY_MAX = 100
CATEGORY_MAX_RATIO = 0.5
DATE_SAMPLE = 200
DATE_SAMPLE_RATE = 0.85
DATE_HINTED_RATE = 0.5
SAMPLES = 5
HIGH_MISSING_PCT = 20

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)
_LONG_TEXT = 64


def _text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (present(column, dtype) + F.lit(0.0).cast(dtype)).cast("string")
    if isinstance(dtype, _NESTED):
        return F.to_json(column)
    if isinstance(dtype, T.BinaryType):
        return F.base64(column)
    return column.cast("string")


def _is_text(dtype: T.DataType) -> bool:
    return not (is_numeric(dtype) or isinstance(dtype, _DATES))


def _dtype_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, _INTEGRAL):
        return "int64"
    if is_numeric(dtype):
        return "float64"
    return "datetime64[ns]" if isinstance(dtype, _DATES) else "object"


def has_date_hint(name: str) -> bool:
    return re.search(DATE_NAME_HINT, name) is not None


def _key(column: Column, dtype: T.DataType) -> tuple[str, Column]:
    """The value as it is counted, and its type: fixed-width where possible.

    Long texts are represented by their SHA-256 so that they are not shuffled themselves.
    """
    if isinstance(dtype, _INTEGRAL + (T.BooleanType,)):
        return "bigint", column.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double", present(column, dtype).cast("double") + F.lit(0.0)
    if isinstance(dtype, _DATES):
        return dtype.simpleString(), column
    value = _text(column, dtype)
    if isinstance(dtype, (T.StringType, T.BinaryType) + _NESTED):
        value = F.when(F.length(value) > _LONG_TEXT,
                       F.concat(F.lit("sha256:"), F.sha2(value, 256))).otherwise(value)
    return "string", value


def counted_text(column: Column, dtype: T.DataType) -> Column:
    """The value as it is counted, as text; NaN is null."""
    return _key(column, dtype)[1].cast("string")


def value_counts(df: DataFrame) -> dict[str, DataFrame]:
    """Rows per (column position, value), one frame per value type.

    One row per column and value leaves each task, so a value that fills a third of the table
    is one row by then. Each frame reads its own columns only.
    """
    kinds: dict[str, list[Column]] = {}
    for i, f in enumerate(df.schema.fields):
        kind, value = _key(quoted(f.name), f.dataType)
        kinds.setdefault(kind, []).append(value.alias(str(i)))
    counted = {}
    for kind, columns in kinds.items():
        tall = df.select(*columns)
        tall = tall.unpivot([], tall.columns, "position", "value")
        counted[kind] = tall.groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted


def _exact_counts(df: DataFrame, hinted: list[str]) -> DataFrame:
    n, parts = F.col("n"), []
    for kind, counted in value_counts(df).items():
        rates = [F.lit(0).cast("bigint")]
        if kind == "string" and hinted:
            rates += [F.sum(F.when(F.col("position").isin(hinted) & parses(F.col("value"), p), n)
                            .otherwise(0)) for p in DATE_FORMATS]
        parts.append(counted.groupBy("position").agg(
            F.sum("n").alias("total"),
            F.sum(F.when(F.col("value").isNull(), n).otherwise(0)).alias("missing_count"),
            F.count("value").alias("unique_count"),
            *[r.alias(f"_r{j}") for j, r in enumerate(rates[1:])],
        ).select(
            F.col("position").cast("int").alias("position"), "total", "missing_count", "unique_count",
            (F.greatest(rates[0], *[F.col(f"_r{j}") for j in range(len(rates) - 1)])
             if len(rates) > 1 else rates[0]).alias("parsed"),
        ))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _counts(df: DataFrame, exact: bool) -> DataFrame:
    hinted = [
        str(i) for i, f in enumerate(df.schema.fields)
        if _is_text(f.dataType) and has_date_hint(f.name)
    ]
    if exact:
        return _exact_counts(df, hinted)
    columns, aggregates = [], []
    for i, f in enumerate(df.schema.fields):
        value = _text(quoted(f.name), f.dataType)
        columns.append(value.alias(str(i)))
        c = F.col(f"`{i}`")
        parsed = [F.count_if(parses(c, p)) for p in DATE_FORMATS] if str(i) in hinted else []
        aggregates.append(F.struct(
            F.lit(i).alias("position"), F.count(F.lit(1)).alias("total"),
            (F.count(F.lit(1)) - F.count(c)).alias("missing_count"),
            F.approx_count_distinct(c, 0.01).alias("unique_count"),
            (F.greatest(*parsed) if parsed else F.lit(0).cast("bigint")).alias("parsed"),
        ))
    return df.select(*columns).agg(F.array(*aggregates).alias("a")).select(F.inline("a"))


def _order_number(df: DataFrame, column: str) -> Column | None:
    dtype = df.schema[column].dataType
    if isinstance(dtype, _INTEGRAL + (T.FloatType, T.DoubleType)):
        return quoted(column)
    return None


def _openings(df: DataFrame, order_by: Sequence[str], columns: Sequence[str], k: int,
              first_width: int = 1 << 12, widen: int = 1 << 10,
              ) -> tuple[list[tuple[DataFrame, list[str]]], list[str]]:
    """Frames that surely hold the first k non-missing values of the columns beside them.

    Looks at the rows whose leading order number lies within a width of the smallest one, and
    widens for the columns that have too few values there. The bound is a plain filter on the
    order column, so files and row groups past the opening are not read. Columns that stay short
    come second.
    """
    open_columns = list(columns)
    if order_by[0] == FILE:
        return _opening_files(df, open_columns, k)
    number = _order_number(df, order_by[0])
    if number is None:
        return [], open_columns
    ends = df.agg(F.min(number).alias("low"), F.max(number).alias("high")).first()
    if ends["low"] is None or ends["low"] != ends["low"] or ends["high"] != ends["high"]:
        return [], open_columns
    if ends["low"] + first_width >= ends["high"]:
        return [(df, open_columns)], []
    width, found = first_width, []
    while open_columns and ends["low"] + width < ends["high"]:
        part = df.where(number.isNull() | (number <= ends["low"] + width))
        held = part.agg(*[F.count(_text(quoted(c), df.schema[c].dataType)).alias(f"n{i}")
                          for i, c in enumerate(open_columns)]).first()
        full = [c for i, c in enumerate(open_columns) if held[f"n{i}"] >= k]
        if full:
            found.append((part, full))
        open_columns = [c for c in open_columns if c not in full]
        width *= widen
    return found, open_columns


def _opening_files(df: DataFrame, open_columns: list[str], k: int, widths: Sequence[int] = (1, 32, 1024),
                   ) -> tuple[list[tuple[DataFrame, list[str]]], list[str]]:
    """As ``_openings``, by the first files: a filter on the file's name, so that no other file is opened."""
    found = []
    for width in widths:
        names = first_files(df, width)
        if not open_columns or not names:
            break
        part = df.where(F.col(FILE) <= names[-1])
        if len(names) < width:  # these are all files
            return [*found, (part, open_columns)], []
        held = part.agg(*[F.count(_text(quoted(c), df.schema[c].dataType)).alias(f"n{i}")
                          for i, c in enumerate(open_columns)]).first()
        full = [c for i, c in enumerate(open_columns) if held[f"n{i}"] >= k]
        if full:
            found.append((part, full))
        open_columns = [c for c in open_columns if c not in full]
    return found, open_columns


def _firsts(df: DataFrame, order_by: Sequence[str], columns: Sequence[str], k: int) -> DataFrame:
    """First k non-missing values as (column, order keys and value).

    An opening is small, so its columns are ranked together. A column that needs the whole table
    is a top-k of its own: it reads that column and the order columns, and k rows leave a task.
    """
    names = [f"_o{j}" for j in range(len(order_by))]
    keys = [quoted(c).alias(n) for c, n in zip(order_by, names)]
    texts = {c: _text(quoted(c), df.schema[c].dataType) for c in columns}
    openings, rest = _openings(df, order_by, columns, k)
    parts = []
    for frame, held in openings:
        tall = frame.select(*keys, *[texts[c].alias(c) for c in held]).unpivot(
            names, [quoted(c) for c in held], "column", "value").where(F.col("value").isNotNull())
        rank = F.row_number().over(W.partitionBy("column").orderBy(*names, "value"))
        parts.append(tall.withColumn("_rank", rank).where(F.col("_rank") <= k))
    for c in rest:
        parts.append(
            df.select(*keys, texts[c].alias("value")).where(F.col("value").isNotNull())
            .orderBy(*names, "value").limit(k).withColumn("column", F.lit(c)))
    result = parts[0].select("column", F.struct(*names, "value").alias("v"))
    for part in parts[1:]:
        result = result.unionByName(part.select("column", F.struct(*names, "value").alias("v")))
    return result


def _in_order(df: DataFrame, order_by: Sequence[str] | None) -> tuple[DataFrame, Sequence[str]]:
    return (df, order_by) if order_by else in_file_order(df)


def first_values(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """First non-missing values of each column in file order, as ordered arrays.

    Without ``order_by`` it is the order of the files' names and of the rows in them.
    """
    place = {c: i for i, c in enumerate(df.columns)}
    renamed = df.toDF(*[f"c{i}" for i in place.values()])
    order = [f"c{place[c]}" for c in order_by] if order_by else None
    ranked, order = _in_order(renamed, order)
    return _firsts(ranked, order, renamed.columns, SAMPLES).groupBy(
        F.substring("column", 2, 9).cast("int").alias("position")).agg(
        F.transform(F.sort_array(F.collect_list("v")), lambda v: v["value"]).alias("sample_values"))


def date_samples(df: DataFrame, columns: Sequence[str],
                 order_by: Sequence[str] | None = None) -> DataFrame:
    """How many of a text column's first values there are, and how many fit its best date format.

    A text too long for any date is counted by a mark instead of being carried along.
    """
    place = {c: i for i, c in enumerate(df.columns)}
    ranked, order = _in_order(df, order_by)
    keys = [quoted(c).alias(f"k{j}") for j, c in enumerate(order)]
    short = ranked.select(*keys, *[
        F.when(F.length(F.trim(quoted(c))) > LONGEST_DATE, "-").otherwise(F.trim(quoted(c)))
        .alias(f"c{place[c]}")
        for c in columns])
    firsts = _firsts(short, [f"k{j}" for j in range(len(order))], [f"c{place[c]}" for c in columns],
                     DATE_SAMPLE)
    fitting = [F.count_if(parses(F.col("v.value"), p)) for p in DATE_FORMATS]
    return firsts.groupBy(F.substring("column", 2, 9).cast("int").alias("position")).agg(
        F.count(F.lit(1)).alias("sampled"), F.greatest(*fitting).alias("sampled_dates"))


def duplicate_counts(df: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Row count and number of rows that repeat an earlier one; one row.

    Rows are first counted by a 128-bit fingerprint, so 16 bytes a row are shuffled instead of
    the row. Without a repeated fingerprint that is the answer. Otherwise the rows behind the
    repeated ones are compared in full: their fingerprints are broadcast when counted to be few
    (copies then collapse within each task), and joined by shuffle when they are many.
    """
    comparable = df.select(*[
        (F.to_json(quoted(f.name)) if isinstance(f.dataType, T.MapType) else quoted(f.name))
        .alias(f.name) for f in df.schema.fields
    ])
    names = [quoted(c) for c in df.columns]
    marked = comparable.withColumns({
        "_h1": F.xxhash64(*names), "_h2": F.xxhash64(F.lit("second"), *names)})
    groups = marked.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    seen = groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count_if(F.col("_n") == 1).alias("once"),
        F.count_if(F.col("_n") > 1).alias("repeated"),
    ).first()
    rows, once, repeated = seen["rows"], seen["once"], seen["repeated"]
    if repeated == 0:
        counted = literal_rows(df.sparkSession, [(rows, 0)], ["row_count", "duplicate_row_count"])
        return counted.select(*[F.col(c).cast("bigint").alias(c) for c in counted.columns])
    again = groups.where(F.col("_n") > 1).select("_h1", "_h2")
    if repeated <= broadcast_rows:
        again = F.broadcast(again)
    compared = marked.join(again, ["_h1", "_h2"], "left_semi").drop("_h1", "_h2").distinct()
    return compared.agg(F.count(F.lit(1)).alias("_distinct")).select(
        F.lit(rows).cast("bigint").alias("row_count"),
        (F.lit(rows - once) - F.col("_distinct")).cast("bigint").alias("duplicate_row_count"),
    )


def profile_columns(df: DataFrame, order_by: Sequence[str] | None = None,
                    exact: bool = True) -> DataFrame:
    """One row per column: counts, samples in file order, detected type and suggested role.

    ``exact=False`` takes approximate distinct counts in a single pass without a shuffle of
    values, for very large or wide tables.
    """
    meta = literal_rows(
        df.sparkSession,
        [(i, f.name, _dtype_name(f.dataType), _is_text(f.dataType), has_date_hint(f.name))
         for i, f in enumerate(df.schema.fields)],
        ["position", "name", "dtype", "is_text", "hinted"],
    )
    texts = [f.name for f in df.schema.fields
             if isinstance(f.dataType, T.StringType) and not has_date_hint(f.name)]
    parts = [_counts(df, exact), first_values(df, order_by)]
    if texts:
        parts.append(date_samples(df, texts, order_by))
    facts = meta.withColumns({"sampled": F.lit(None).cast("bigint"),
                              "sampled_dates": F.lit(None).cast("bigint")})
    for part in parts:
        facts = facts.unionByName(part, allowMissingColumns=True)
    joined = facts.groupBy("position").agg(*[
        F.first(c, ignorenulls=True).alias(c) for c in facts.columns if c != "position"])
    return classified(joined)


def classified(joined: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Type, role and shown counts of columns, from what was counted of them; ``keys`` come first."""
    zero = F.lit(0).cast("bigint")
    total, missing = F.coalesce("total", zero), F.coalesce("missing_count", zero)
    unique = F.coalesce("unique_count", zero)
    values = F.coalesce("sample_values", F.array().cast("array<string>"))
    counted = total - missing
    like_date = F.col("is_text") & (counted > 0) & F.when(
        F.col("hinted"), F.col("parsed") >= counted * DATE_HINTED_RATE,
    ).otherwise(F.coalesce(F.col("sampled_dates") >= F.col("sampled") * DATE_SAMPLE_RATE,
                           F.lit(False)))
    has_gaps = missing > 0
    raw = (
        F.when((F.col("dtype") == "int64") & has_gaps, "float64")
        .when((F.col("dtype") == "bool") & has_gaps, "object").otherwise(F.col("dtype"))
    )
    detected = (
        F.when(F.col("dtype") == "datetime64[ns]", "date")
        .when(~F.col("is_text"),
              F.when(unique <= NUMERIC_CATEGORY_MAX, "categorical").otherwise("numeric"))
        .when(like_date, "date")
        .when((unique <= CATEGORY_MAX) | (unique <= total * CATEGORY_MAX_RATIO), "categorical")
        .otherwise("text")
    )
    role = (
        F.when(F.col("detected_type") == "date", "date")
        .when(F.col("detected_type") == "numeric", "measure").otherwise("dimension")
    )
    pct = F.when(total > 0, F.round(missing * 100 / total, 2)).otherwise(0.0)
    return joined.withColumn("detected_type", detected).select(
        *keys, "position", "name", raw.alias("raw_dtype"), "detected_type",
        role.alias("suggested_role"), missing.alias("missing_count"), pct.alias("missing_pct"),
        unique.alias("unique_count"), values.alias("sample_values"),
    )


def with_role_overrides(profile: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Role in effect: the override where given, else the suggestion."""
    given = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]).cast(
        "map<string,string>") if overrides else F.create_map().cast("map<string,string>")
    return profile.withColumn("role", F.coalesce(F.try_element_at(given, F.col("name")),
                                                 F.col("suggested_role")))


def without_ignored(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    return df.select(*[quoted(c) for c in df.columns if overrides.get(c) != "ignore"])


def missing_warnings(profile: DataFrame) -> DataFrame:
    """Columns missing more than a fifth of their values are marked; none missing shows a dash."""
    shown = F.when(F.col("missing_pct") > 0,
                   F.concat(F.col("missing_pct").cast("string"), F.lit("%"))).otherwise("—")
    return profile.withColumn("missing_text", shown).withColumn(
        "high_missing", F.col("missing_pct") > HIGH_MISSING_PCT)


def digest(profile: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The column lines an interview starts from, as one text; one for each of ``keys``, where given."""
    def literal(v: Column) -> Column:
        escaped = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
        double = v.contains("'") & ~v.contains('"')
        return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(
            F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'")))

    bare = F.col("raw_dtype").isin("int64", "float64", "bool")
    shown = F.transform(F.slice("sample_values", 1, 2),
                        lambda v: F.when(bare, v).otherwise(literal(v)))
    line = F.concat(
        F.lit("  - "), literal(F.col("name")), F.lit(": "), "detected_type",
        F.lit(", role="), "suggested_role",
        F.when(F.size("sample_values") > 0,
               F.concat(F.lit(", e.g. ["), F.array_join(shown, ", "), F.lit("]"))).otherwise(""),
    )
    lines = F.sort_array(F.collect_list(F.struct("position", line.alias("line"))))
    return profile.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("digest"))


def upload_profiles(uploads: DataFrame, staging: DataFrame) -> DataFrame:
    """Profile of each upload, or why there is none yet."""
    stored = staging.select("upload_id", "profile_data")
    answer = (
        F.when(F.col("status").isin("pending", "profiling"), "Profiling still in progress.")
        .when(F.col("status") == "failed",
              F.concat(F.lit("Profiling failed: "), F.coalesce("error_message", F.lit("None"))))
        .when(F.coalesce("profile_data", F.lit("")) == "", "Profile data not found.")
    )
    return (
        uploads.join(stored, "upload_id", "left").withColumn("message", answer)
        .withColumn("profile_data", F.when(F.col("message").isNull(), F.col("profile_data")))
    )
