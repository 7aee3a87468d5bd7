"""Running totals and neighbours that never put one whole key into one task."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kpiloom.session import scratch_path

BLOCK_ROWS = 1 << 20
FAN = 4096


def in_blocks(df: DataFrame, keys: list[str], position: str, rows: int, size: int | None) -> tuple[DataFrame, int]:
    """``df`` with ``_block``, and the number of blocks.

    Blocks are ranges of (keys, position) cut where about ``rows`` rows are full, so they follow where the rows are
    and not how far apart their positions lie. ``size`` is the number of rows or a bound on it; without it they are
    counted. The ranges are written once, since sampling them again would cut elsewhere.
    """
    blocks = max(1, math.ceil((df.count() if size is None else size) / rows))
    if blocks == 1:
        return df.withColumn("_block", F.lit(0)), 1
    path = scratch_path(df.sparkSession, "running-blocks")
    df.repartitionByRange(blocks, *keys, position).withColumn("_block", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), blocks


def _matched(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the row of ``right`` at the same keys, null ones included, and the same ``at``."""
    names = [*keys, at]
    side = right.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(names)], value)
    same = reduce(Column.__and__, [left[c].eqNullSafe(side[f"_on{i}"]) for i, c in enumerate(names)])
    return left.join(side, same, "left").drop(*[f"_on{i}" for i in range(len(names))])


def _carried(totals: DataFrame, keys: list[str], at: str, blocks: int, fan: int, sign: int,
             fold: Callable[[Column, Column], Column], seen: Callable[[Column], Column],
             both: Callable[[Column, Column], Column]) -> DataFrame:
    """``totals`` (keys, ``at``, _total) with ``_before``: what the blocks before carry over.

    Blocks are folded level by level, ``fan`` to one, so no task gets more than ``fan`` totals of a key.
    """
    order = F.col(at) * sign
    if blocks <= fan:
        before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return totals.withColumn("_before", seen(F.col("_total")).over(before))
    up = f"{at}_up"
    grouped = totals.withColumn(up, F.floor(F.col(at) / fan))
    above = _carried(
        grouped.groupBy(*keys, up).agg(fold(F.col("_total"), order).alias("_total")), keys, up,
        math.ceil(blocks / fan), fan, sign, fold, seen, both).withColumnRenamed("_before", "_above")
    inside = W.partitionBy(*keys, up).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = grouped.withColumn("_near", seen(F.col("_total")).over(inside))
    return (
        _matched(local, above, keys, up, "_above")
        .withColumn("_before", both(F.col("_near"), F.col("_above"))).drop(up, "_near", "_above")
    )


def running_total(df: DataFrame, keys: list[str], position: str, value: str, out: str,
                  rows: int = BLOCK_ROWS, size: int | None = None, fan: int = FAN) -> DataFrame:
    """Running sum of ``value`` per key in ``position`` order.

    Positions are unique within a key. Each key is cut into blocks of about ``rows`` rows; a block is summed on its own,
    the block totals get a running sum, and both add up. A key that holds a third of all rows is thus spread
    over many tasks, however sparse or dense its positions are. Null keys are one key.
    """
    blocked, blocks = in_blocks(df, keys, position, rows, size)
    inside = (
        W.partitionBy(*keys, "_block").orderBy(position)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = blocked.withColumn("_inside", F.sum(value).over(inside))
    if blocks == 1:
        return local.withColumn(out, F.col("_inside")).drop("_block", "_inside")
    nothing = F.lit(0)
    offsets = _carried(
        blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total")), keys, "_block", blocks, fan, 1,
        fold=lambda total, order: F.sum(total), seen=F.sum,
        both=lambda near, above: F.coalesce(near, nothing) + F.coalesce(above, nothing))
    return (
        _matched(local, offsets, keys, "_block", "_before")
        .withColumn(out, F.coalesce("_inside", nothing) + F.coalesce("_before", nothing))
        .drop("_block", "_inside", "_before")
    )


def neighbour(df: DataFrame, keys: list[str], position: str, value: str, out: str, previous: bool = True,
              rows: int = BLOCK_ROWS, size: int | None = None, fan: int = FAN) -> DataFrame:
    """``value`` of the row before (or after) in ``position`` order within each key.

    Works on blocks like :func:`running_total`: only the edge row of a block looks across, at the nearest
    block of its key that has rows.
    """
    sign = 1 if previous else -1
    blocked, blocks = in_blocks(df, keys, position, rows, size)
    order = F.col(position).asc() if previous else F.col(position).desc()
    inside = W.partitionBy(*keys, "_block").orderBy(order)
    local = blocked.withColumn("_inside", F.lag(value).over(inside))
    if blocks == 1:
        return local.withColumn(out, F.col("_inside")).drop("_block", "_inside")
    local = local.withColumn("_edge", F.row_number().over(inside) == 1)
    nearest = F.max_by if previous else F.min_by
    edges = _carried(
        blocked.groupBy(*keys, "_block").agg(nearest(F.struct(value), F.col(position)).alias("_total")),
        keys, "_block", blocks, fan, sign,
        fold=F.max_by, seen=F.last, both=F.coalesce)
    return (
        _matched(local, edges, keys, "_block", "_before")
        .withColumn(out, F.when(F.col("_edge"), F.col(f"_before.{value}")).otherwise(F.col("_inside")))
        .drop("_block", "_edge", "_inside", "_before")
    )
