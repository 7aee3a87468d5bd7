"""Column profile kept by a file stream: counts and distinct sketches per file, merged instead of scanned again."""

from __future__ import annotations

from collections.abc import Sequence
from math import sqrt

from pyspark.sql import DataFrame, functions as F

from kpiloom.operators.profile import counted_text
from kpiloom.sources.delimited import quoted

# A sketch of 2^SKETCH_BITS registers takes 4 KB at most; its standard error is 1.04 / sqrt(registers), and
# DISTINCT_ERROR is four times that.
SKETCH_BITS = 12
DISTINCT_ERROR = 4 * 1.04 / sqrt(1 << SKETCH_BITS)


def profile_parts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key and column: rows, missing values and a sketch of the distinct ones.

    One row of counts and sketches per key leaves each task. Values count as in the exact profile: NaN is missing, texts
    are taken whole. Columns named in ``keys`` are not profiled.
    """
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    fields = [f for f in df.schema.fields if f.name not in keys]
    for i, field in enumerate(fields):
        value = counted_text(quoted(field.name), field.dataType)
        aggregates += [F.count(value).alias(f"_n{i}"), F.hll_sketch_agg(value, SKETCH_BITS).alias(f"_s{i}")]
    wide = df.groupBy(*keys).agg(*aggregates)
    tall = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(field.name).alias("column"), F.col("_rows").alias("total"),
                 (F.col("_rows") - F.col(f"_n{i}")).alias("missing_count"), F.col(f"_s{i}").alias("sketch"))
        for i, field in enumerate(fields)])
    return wide.select(*keys, F.inline(tall))


def merged_profile(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The profile of all parts together, per column: exact counts, ``unique_estimate`` within :data:`DISTINCT_ERROR`."""
    return (
        parts.groupBy(*keys, "position", "column").agg(
            F.sum("total").alias("total"), F.sum("missing_count").alias("missing_count"),
            F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("unique_estimate"))
        .withColumn("missing_rate", F.try_divide("missing_count", "total"))
    )


def refresh_profile(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Profile every file not seen yet, one part per file and column, and return when all are done.

    A batch repeated after a failure replaces its own parts.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        profile_parts(batch, ["_file"]).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    (
        stream.withColumn("_file", F.col("_metadata.file_path")).writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
