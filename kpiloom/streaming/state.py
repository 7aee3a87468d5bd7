"""Latest state per request kept by a stream of updates: keyed state for late and repeated ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from kpiloom.operators.governance import latest_fields, shown_fields

STATE = "_state"


def follow(updates: DataFrame, fields: Sequence[str], target: str, checkpoint: str, key: str = "request_id",
           seq: str = "seq", at: str = "updated_at") -> None:
    """Take in all updates not seen yet and return when they are done.

    The state store holds per key and field the write with the highest ``seq``, so an update that comes late or twice changes
    nothing. A micro-batch writes the keys it changed under its own number: repeated after a failure, it
    replaces itself. State never expires, as a request may be updated at any time; it is one row a request.
    """
    kept = updates.groupBy(key).agg(*latest_fields(fields, seq), F.max(at).alias(at))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    (
        kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )


def current_state(spark: SparkSession, target: str, fields: Sequence[str], key: str = "request_id",
                  at: str = "updated_at") -> DataFrame:
    """The state after all batches so far, like :func:`kpiloom.operators.governance.latest_state` over all updates."""
    batches = spark.read.parquet(target)
    newest = batches.groupBy(key).agg(F.max_by(F.struct(*fields, at), "batch").alias(STATE))
    return shown_fields(newest.select(key, f"{STATE}.*"), fields, key, at)
