"""Refresh on new files: mergeable KPI sums kept by a file stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kpiloom.functions.numbers import EXACT_PARTS, exact_parts, exact_value, present
from kpiloom.operators.kpi import ColumnMapping, KpiDef, kpis_from_totals


_FOLDED = "-folded"


def partial_sums(facts: DataFrame, keys: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Per key: rows, and the exact parts of each column's sum, which add up across files."""
    sums = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        dtype = facts.schema[c].dataType
        if not isinstance(dtype, T.IntegralType):
            dtype = T.DoubleType()
        value = present(F.col(c).cast(dtype), dtype)
        sums += [part.alias(f"{c}__{name}") for name, part in exact_parts(value, dtype).items()]
    return facts.groupBy(*keys).agg(*sums)


def _merged(stored: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    parts = [f"{c}__{name}" for c in columns for name in EXACT_PARTS]
    return stored.groupBy(*keys).agg(*[F.sum(p).alias(p) for p in ["rows", *parts]])


def file_checks(facts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Files that bring no value at all for a column they should have, with the flag text.

    ``facts`` carries the file path as ``_file``; one row per file leaves each task.
    """
    held = facts.groupBy("_file").agg(*[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)])
    gaps = [F.when(F.col(f"_n{i}") == 0, F.lit(f"column '{c}' missing"))
            for i, c in enumerate(columns)]
    return held.select(F.col("_file").alias("file"), F.explode(F.array_compact(F.array(*gaps)))
                       .alias("flag"))


def refresh(spark: SparkSession, stream: DataFrame, keys: Sequence[Column], columns: Sequence[str],
            target: str, checkpoint: str, flags_target: str | None = None) -> None:
    """Take in every file not seen yet and return when all are done.

    Each micro-batch writes its sums under its own batch number, so a batch repeated after a
    failure replaces itself. Ratios are never stored, only their sums. With ``flags_target`` each
    new file is checked for the columns it should bring.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        partial_sums(batch, keys, columns).write.mode("overwrite").parquet(
            f"{target}/batch={batch_id}")
        if flags_target is not None:
            file_checks(batch, columns).write.mode("overwrite").parquet(
                f"{flags_target}/batch={batch_id}")

    if flags_target is not None:
        stream = stream.withColumn("_file", F.col("_metadata.file_path"))
    query = (
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_totals(spark: SparkSession, target: str, keys: Sequence[str],
                   columns: Sequence[str]) -> DataFrame:
    """Totals over all batches so far, as doubles."""
    merged = _merged(_stored(spark, target), keys, columns)
    return merged.select(*keys, "rows", *[
        exact_value({name: F.col(f"{c}__{name}") for name in EXACT_PARTS}).alias(c)
        for c in columns])


def current_kpis(spark: SparkSession, target: str, keys: Sequence[str], columns: Sequence[str],
                 kpi_list: Sequence[str], catalog: dict[str, KpiDef],
                 mapping: dict[str, ColumnMapping]) -> DataFrame:
    """Report KPIs over everything taken in so far, per key; ratios are formed here."""
    totals = current_totals(spark, target, keys, columns)
    where = {c: F.col(c) for c in columns}
    results = kpis_from_totals(totals, where, kpi_list, catalog, mapping, list(columns),
                               list(columns))
    return results.select(*keys, "position", "kpi_id", "in_catalog", "value", "flags",
                          "report_flags")


def compact(spark: SparkSession, target: str, keys: Sequence[str], columns: Sequence[str]) -> None:
    """Fold all batches so far into one table of sums, so that reading does not grow with batches.

    The fold carries the number of the last batch in it. Readers take the newest fold and the batches
    after it, so batches may keep coming to the same place, and a fold cut off by a failure is made again.
    """
    last = spark.read.parquet(target).agg(F.max("batch")).first()[0]
    _merged(_stored(spark, target), keys, columns).write.mode("overwrite").parquet(
        f"{target}{_FOLDED}/upto={last}")


def _stored(spark: SparkSession, target: str) -> DataFrame:
    """The newest fold and the batches after it; all batches when none is folded."""
    batches = spark.read.parquet(target)
    try:
        folds = spark.read.parquet(f"{target}{_FOLDED}")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return batches.drop("batch")
    upto = folds.agg(F.max("upto")).first()[0]
    return folds.where(F.col("upto") == upto).drop("upto").unionByName(
        batches.where(F.col("batch") > upto).drop("batch"))
