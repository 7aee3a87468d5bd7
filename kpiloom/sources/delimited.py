"""Delimited uploads: scan, missing-value tokens, column types, header names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kpiloom.functions.text import normalise_headers
from kpiloom.schemas import NULL_TOKENS
from kpiloom.sources.order import in_file_order

_BOOLEAN_WORDS = ["True", "False", "TRUE", "FALSE", "true", "false"]
# Checked by pattern before any cast: a failing number parse costs an exception per value.
_WHOLE = r"^\s*[+-]?\d+\s*$"
_SURPLUS = "_surplus"
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def null_token_as_null(column: Column) -> Column:
    return F.when(~column.isin(NULL_TOKENS), column)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def files_by_header(spark: SparkSession, path: str | list[str]) -> list[list[str]]:
    """The files of an upload, those with the same first line together."""
    lines, order = in_file_order(spark.read.text(path))
    firsts = lines.where(F.col(order[1]) == 0).groupBy(order[0]).agg(F.min_by("value", order[2]).alias("header"))
    groups = firsts.groupBy("header").agg(F.sort_array(F.collect_list(order[0])).alias("files"))
    return [r["files"] for r in groups.orderBy(F.element_at("files", 1)).collect()]


def read_text_columns(spark: SparkSession, path: str | list[str], sep: str = ",",
                      multi_line: bool = True, long_rows: str = "fail") -> DataFrame:
    """Header-row files as text columns with missing-value tokens as null.

    Columns are aligned by name: files with another header order, or lacking a column, are read by
    their own header. A row with fewer fields than the header ends in nulls; one with more fails the
    read, unless ``long_rows`` is ``"cut"``.

    Quoted line breaks need ``multi_line``, which reads each file in one task; an admitted
    upload is at most 50 MB. Larger exports without line breaks in values should turn it off so
    that files are split.
    """
    options = {"header": True, "sep": sep, "multiLine": multi_line, "escape": '"'}

    def read(files: str | list[str]) -> DataFrame:
        names = spark.read.csv(files, inferSchema=False, **options).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _SURPLUS)])
        raw = spark.read.csv(files, schema=schema, **options)
        if long_rows == "fail":
            fits = F.assert_true(F.col(_SURPLUS).isNull(), "a row has more fields than the header")
            raw = raw.where(fits.isNull())
        return raw.select(*[null_token_as_null(quoted(c)).alias(c) for c in names])

    groups = files_by_header(spark, path)
    if len(groups) < 2:
        return read(path)
    frames = [read(files) for files in groups]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def infer_types(text: DataFrame) -> dict[str, T.DataType]:
    """Whole-column types from one aggregate pass: long, double, boolean, else text.

    An all-missing column is double. Whole numbers that no long holds keep their digits as text.
    """
    checks = []
    for i, name in enumerate(text.columns):
        value = quoted(name)
        checks += [
            F.count(value).alias(f"n{i}"),
            F.count_if(value.rlike(_WHOLE)).alias(f"w{i}"),
            F.count_if(F.when(value.rlike(_WHOLE), F.trim(value).try_cast("bigint").isNotNull()))
            .alias(f"l{i}"),
            F.count_if(value.rlike(_NUMBER)).alias(f"d{i}"),
            F.count_if(value.isin(_BOOLEAN_WORDS)).alias(f"b{i}"),
        ]
    if not checks:
        return {}
    seen = text.agg(*checks).first()
    types: dict[str, T.DataType] = {}
    for i, name in enumerate(text.columns):
        n = seen[f"n{i}"]
        if n == 0:
            types[name] = T.DoubleType()
        elif seen[f"b{i}"] == n:
            types[name] = T.BooleanType()
        elif seen[f"l{i}"] == n:
            types[name] = T.LongType()
        elif seen[f"w{i}"] == n:
            types[name] = T.StringType()
        elif seen[f"d{i}"] == n:
            types[name] = T.DoubleType()
        else:
            types[name] = T.StringType()
    return types


def scan_delimited(spark: SparkSession, path: str | list[str],
                   types: dict[str, T.DataType] | None = None, sep: str = ",",
                   multi_line: bool = True, long_rows: str = "fail") -> DataFrame:
    """Typed frame of a delimited upload; pass ``types`` to skip the inference pass."""
    text = read_text_columns(spark, path, sep, multi_line, long_rows)
    types = infer_types(text) if types is None else types
    return text.select(*[
        quoted(c).alias(c) if isinstance(types.get(c, T.StringType()), T.StringType)
        else F.trim(quoted(c)).try_cast(types[c]).alias(c)
        for c in text.columns
    ])


def with_normalised_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalise_headers(df.columns))
