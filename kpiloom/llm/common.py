"""Helpers shared by the operators: words, written intermediate tables, ranks and connected components."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiloom.session import scratch_path

SEPARATORS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")


def materialised(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back: its lineage ends there, so a lost
    executor costs no earlier stage, and later reads see the same rows in the same parts."""
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def with_running(
    frame: DataFrame, group: Sequence[str], order: Sequence[Column], value: str, name: str
) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same group that come earlier.

    Rows are cut into ranges of (group, order), so a group of any size is spread over many tasks; a
    range's start is the sum of the ranges before it, of which there are as many as partitions.
    """
    keys = [F.col(c).asc_nulls_last() for c in group]
    ranged = materialised(
        frame.repartitionByRange(*keys, *order).withColumn("range_id", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*group).orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*group, "range_id").agg(F.sum(value).alias("range_sum"))
        .select(*[F.col(c).alias(f"of_{c}") for c in (*group, "range_id")],
                F.coalesce(F.sum("range_sum").over(earlier), F.lit(0)).alias("range_start")))
    on = F.lit(True)
    for c in (*group, "range_id"):
        on = on & F.col(c).eqNullSafe(F.col(f"of_{c}"))
    joined = ranged.join(starts, on).select(*ranged.columns, "range_start")
    inside = (Window.partitionBy(*group, "range_id").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(
        "before", F.col("range_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    ).drop("range_id", "range_start")


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that reaches a smaller one: the smallest it reaches.

    Alternating large-star and small-star rounds: each node's neighbours are hung on the smallest
    one, until only stars are left. Every round is written out; the only thing the driver sees is a
    count and a checksum of the edges.
    """
    pairs = materialised(edges.select("a", "b").where("a <> b").distinct(), name)
    seen = None
    while True:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = materialised(large, name)
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(
            least.select("a", F.col("m").alias("b"))).distinct()
        pairs = materialised(small, name)
        state = tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
