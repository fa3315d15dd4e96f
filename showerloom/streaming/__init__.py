"""Streams of steps: whole events arrive per micro-batch, so batch operators apply unchanged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery



def compress_stream(steps: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Runs operator on each micro-batch and writes its point cloud under path/batch=N.

    Events must not be split over batches.  A batch that is run again after a failure replaces what
    it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").partitionBy("subdetector").parquet(f"{path}/batch={number}")

    return steps.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


__all__ = ["compress_stream"]
