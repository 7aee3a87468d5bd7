"""Many delimited uploads read together: one scan whatever their headers, with the upload as a column.

Files lie at ``<folder>/<upload_id>/<name>``, or in a folder ``upload_id=<upload_id>``, at any depth. A file's records and fields are cut by patterns inside Spark, so
files of any header are rows of one frame and a bad file is a value, not a failed job.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from kpiloom.functions.text import normalise_headers
from kpiloom.schemas import NULL_TOKENS
from kpiloom.sources import uploads

# A record is no line break outside quotes, a field no separator; groups are possessive, so long ones are loops.
_RECORD = r'(?:[^"\n\r]++|"(?:[^"]++|"")*+")++'


def _field(sep: str) -> str:
    s = "\\" + sep
    return f'{s}((?:"(?:[^"]++|"")*+"(?={s}|\\z))|[^{s}]*+)'


def fields_of(record: Column, sep: str = ",") -> Column:
    """The fields of one record, quotes around them gone and doubled ones single."""
    found = F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(_field(sep)), F.lit(1))
    return F.transform(found, lambda f: F.when(
        f.startswith('"') & f.endswith('"') & (F.length(f) > 1),
        F.replace(f.substr(F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def _paths(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = F.split("path", "/")
    return files.select(
        "path", F.regexp_replace(F.try_element_at(parts, F.lit(-2)), "^upload_id=", "").try_cast("bigint").alias("upload_id"),
        F.element_at(parts, -1).alias("filename"), F.col("length").alias("size_bytes"), "content")


def admitted_files(spark: SparkSession, folder: str, allowed: list[str]) -> DataFrame:
    """Every file with its upload, whether it is admitted and why not; contents are not read."""
    listed = _paths(spark, folder).drop("content").where("upload_id IS NOT NULL")
    return uploads.admit(listed, allowed=allowed).select(
        "path", "upload_id", "filename", "size_bytes", "accepted", "reason")


def records(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    """(path, upload_id, records, problem) of the CSV files that are small enough to be admitted: the texts of a
    file's records in order. A file is one task's work, as an upload is limited to 50 MB."""
    files = _paths(spark, folder).where(
        F.col("upload_id").isNotNull() & F.col("filename").rlike(r"(?i)\.csv$")
        & (F.col("size_bytes") <= uploads.MAX_UPLOAD_BYTES))
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    bare = F.regexp_replace(F.when(valid, text), "^﻿", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    problem = F.when(~valid, "the file is not UTF-8 text").when(quotes % 2 == 1, "a quote is not closed")
    return files.select("path", "upload_id", bare.alias("text"), problem.alias("problem")).select(
        "path", "upload_id", "problem",
        F.when(F.col("problem").isNull(), F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0))).alias("records"))


def headers(read: DataFrame, sep: str = ",") -> DataFrame:
    """(path, upload_id, names, n_rows, problem) of every file. A row longer than the header is a problem."""
    names = fields_of(F.get("records", F.lit(0)), sep)
    widest = F.array_max(F.transform("records", lambda r: F.size(fields_of(r, sep))))
    return read.select(
        "path", "upload_id", "problem", names.alias("names"), widest.alias("widest"), F.size("records").alias("n")).select(
        "path", "upload_id", "names", F.greatest(F.col("n") - 1, F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce("problem", F.when(F.col("n") == 0, "the file has no header"),
                   F.when(F.col("widest") > F.size("names"), "a row has more fields than the header")).alias("problem"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _normalised(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for names in lists:
        yield names.map(lambda n: normalise_headers(list(n)))


def layout(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Columns of each upload and where each file has them, from ``headers`` without problems.

    First (upload_id, columns): normalised names in the order in which the upload's files, by path, first have
    them; a name that a header repeats is a column each time. Second (path, upload_id, before, places): rows of
    the upload's files before this one, and for each column the file's field, null where it lacks it.
    """
    named = files.select("path", "upload_id", F.posexplode("names").alias("place", "name"))
    again = F.row_number().over(W.partitionBy("path", "name").orderBy("place"))
    named = named.withColumn("again", again)
    first = named.groupBy("upload_id", "name", "again").agg(F.min(F.struct("path", "place")).alias("first"))
    listed = first.groupBy("upload_id").agg(F.sort_array(F.collect_list(F.struct("first", "name", "again"))).alias("c"))
    columns = listed.select("upload_id", _normalised(F.transform("c", lambda x: x["name"])).alias("columns"))
    placed = listed.select("upload_id", F.posexplode("c").alias("position", "c")).select(
        "upload_id", "position", F.col("c.name").alias("name"), F.col("c.again").alias("again"))
    held = named.join(placed, ["upload_id", "name", "again"]).groupBy("path", "upload_id").agg(
        F.map_from_entries(F.collect_list(F.struct("position", "place"))).alias("held"))
    earlier = W.partitionBy("upload_id").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    rows = files.select("path", F.coalesce(F.sum("n_rows").over(earlier), F.lit(0)).alias("before"))
    width = listed.select("upload_id", F.size("c").alias("width"))
    places = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda p: F.try_element_at("held", p))
    return columns, held.join(rows, "path").join(width, "upload_id").select("path", "upload_id", "before", places.alias("places"))


def rows(read: DataFrame, places: DataFrame, sep: str = ",") -> DataFrame:
    """(upload_id, row, values): every row of the files in ``places``, numbered through the upload's files in order;
    values are texts by the upload's columns, missing-value words and fields that a row lacks null."""
    held = read.select("path", "records").join(places, "path").select(
        "upload_id", "before", "places", F.posexplode(F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0)))).alias("at", "record"))
    values = held.select("upload_id", (F.col("before") + F.col("at")).alias("row"), "places", fields_of(F.col("record"), sep).alias("f"))
    return values.select("upload_id", "row", F.transform(
        "places", lambda p: F.when(~F.get("f", p).isin(NULL_TOKENS), F.get("f", p))).alias("values"))
