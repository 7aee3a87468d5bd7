"""The order of rows in files, which does not depend on how Spark packs files into tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

FILE, BLOCK, PLACE = "_file", "_block", "_place"


def _reads_files(df: DataFrame) -> bool:
    return "_metadata" in df.columns or bool(df.inputFiles())


def in_file_order(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with the columns that order its rows as they lie in their files: file name, start of the block that a
    task reads, and a running number. The number rises within a block, which one task reads in one go, and is
    compared only there. Rows of no file have only the order in which Spark scans them.

    ``df`` must be what a reader gives, or a selection of its columns and rows.
    """
    running = F.monotonically_increasing_id().alias(PLACE)
    if not _reads_files(df):
        return df.select(F.lit("").alias(FILE), F.lit(0).cast("long").alias(BLOCK), running, "*"), [FILE, BLOCK, PLACE]
    return df.select(
        F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), running, "*",
    ), [FILE, BLOCK, PLACE]


def first_files(df: DataFrame, n: int) -> list[str]:
    """The names of the first ``n`` files of a frame in file order."""
    return [r[FILE] for r in df.select(FILE).distinct().orderBy(FILE).limit(n).collect()]


def with_ordinals(df: DataFrame, name: str = "row") -> DataFrame:
    """Adds the gapless number of each row in file order, from 0: rows are counted per block, the blocks before a block
    are added up, and a row's place in its block comes from the running number. ``df`` holds all rows of its files."""
    placed, _ = in_file_order(df)
    blocks = placed.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_rows"), F.min(PLACE).alias("_first"))
    per_file = blocks.groupBy(FILE).agg(F.sum("_rows").alias("_rows"))
    before_file = per_file.select(
        FILE, F.coalesce(F.sum("_rows").over(W.orderBy(FILE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_files"))
    in_file = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.withColumn("_blocks", F.coalesce(F.sum("_rows").over(in_file), F.lit(0))).join(before_file, FILE).select(
        FILE, BLOCK, (F.col("_files") + F.col("_blocks") - F.col("_first")).alias("_start"))
    return placed.join(starts, [FILE, BLOCK]).select((F.col("_start") + F.col(PLACE)).alias(name), *df.columns)
