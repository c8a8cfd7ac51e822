"""Mapping records as they arrive: each micro-batch runs the batch operators and appends its matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def map_stream(records: DataFrame, match: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes ``match(batch)`` of every micro-batch to ``target``/batch_id=N.

    A batch that is run again after a failure overwrites its own folder, so every record's matches are there once.
    """

    def each(batch: DataFrame, number: int) -> None:
        match(batch).write.mode("overwrite").parquet(f"{target.rstrip('/')}/batch_id={number}")

    writer = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
