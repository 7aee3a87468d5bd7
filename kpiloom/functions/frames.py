"""Small frames from values known when a job is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """Rows of plain values as a plan of literals, whose size Spark knows when it picks joins."""
    packed = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*packed)))
