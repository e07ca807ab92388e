"""Sinks of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def flush_each(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> DataStreamWriter:
    """A writer that commits what came in so far as one folder of Parquet a batch, at each interval or, without one, until the input ends.

    A batch that is repeated after a failure, because its commit was lost, replaces its own folder, so
    each row is there once. Read the rows with ``spark.read.parquet(path)``; ``batch`` tells the flush.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
