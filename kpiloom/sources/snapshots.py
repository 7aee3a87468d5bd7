"""Tables that are replaced as a whole: a snapshot is written beside the others and then named, so a reader sees the old
one or the new one and never a mixture, and a run that fails in between changes nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_NAMES = "version BIGINT, folder STRING"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, folder) of all snapshots that were named; one small file each."""
    return spark.read.schema(_NAMES).option("ignoreMissingFiles", "true").parquet(f"{root}/versions")


def publish(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the next snapshot below ``root`` and return its version.

    The name is appended last, by one task whose file Spark moves into place whole. ``rows`` may be read from the
    snapshot that they replace. Of two runs at once the later name counts, or with equal versions the greater folder.
    """
    spark = rows.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    version = latest(spark, root)[0] + 1
    _name(spark, root, version, folder)
    return version


def _name(spark: SparkSession, root: str, version: int, folder: str) -> None:
    row = spark.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(folder).alias("folder"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def latest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """Version and folder of the snapshot named last; (0, None) before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/versions")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return 0, None
    found = versions(spark, root).orderBy(F.desc("version"), F.desc("folder")).first()
    return (0, None) if found is None else (found["version"], found["folder"])


def current(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the latest snapshot, or of a given one. The frame stays with that snapshot whatever is published
    after it was made."""
    if version is None:
        folder = latest(spark, root)[1]
    else:
        named = versions(spark, root).where(F.col("version") == version).agg(F.max("folder")).first()
        folder = named[0]
    if folder is None:
        raise ValueError(f"no snapshot in {root}")
    return spark.read.parquet(f"{root}/{folder}")
