"""Blocked windows against plain ones, with one key holding most rows."""

import random

import pytest
from pyspark.sql import Window as W, functions as F

from kpiloom.functions.running import in_blocks, neighbour, running_total


def rows(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else rng.choice(["a", "b", "c", None]), i * rng.choice([1, 3]) + i * 5, rng.randrange(9))
            for i in range(600)]
    unique = {(k, p): v for k, p, v in data}
    return spark.createDataFrame([(k, p, v) for (k, p), v in unique.items()], "key string, pos bigint, v int")


@pytest.mark.parametrize("size, fan", [(37, 3), (37, 4096), (10_000, 3)])
def test_running_total_matches_a_window(spark, size, fan):
    df = rows(spark)
    plain = df.withColumn("want", F.sum("v").over(
        W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    got = running_total(plain, ["key"], "pos", "v", "got", rows=size, fan=fan)
    assert got.where("got <> want OR got IS NULL").count() == 0 and got.count() == df.count()


@pytest.mark.parametrize("size, fan", [(41, 2), (41, 4096), (10_000, 2)])
def test_neighbours_match_lag_and_lead(spark, size, fan):
    df = rows(spark)
    order = W.partitionBy("key").orderBy("pos")
    plain = df.withColumn("before", F.lag("v").over(order)).withColumn("after", F.lead("v").over(order))
    got = neighbour(plain, ["key"], "pos", "v", "got_before", True, rows=size, fan=fan)
    got = neighbour(got, ["key"], "pos", "v", "got_after", False, rows=size, fan=fan)
    wrong = got.where(~F.col("before").eqNullSafe(F.col("got_before"))
                      | ~F.col("after").eqNullSafe(F.col("got_after")))
    assert wrong.count() == 0 and got.count() == df.count()


def test_blocks_follow_the_rows_not_the_positions(spark):
    """Microseconds with gaps of days, and half of all rows within one second: no block has over twice its rows."""
    target, n = 1_000, 20_000
    position = F.when(F.col("id") < n // 2, F.col("id")).otherwise(F.col("id") * 86_400_000_000 + F.col("id") % 7)
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("key"),
                               position.alias("pos"), F.lit(1).alias("v"))
    blocked, blocks = in_blocks(df, ["key"], "pos", target, None)
    sizes = [r["count"] for r in blocked.groupBy("_block").count().collect()]
    assert blocks == 20 and sum(sizes) == n and max(sizes) <= 2 * target
    last = running_total(df, ["key"], "pos", "v", "got", rows=target).groupBy("key").agg(F.max("got").alias("got"), F.count("*").alias("n"))
    assert last.where("got <> n").count() == 0
