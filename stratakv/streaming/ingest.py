"""Appending a stream to a store: each micro-batch is one put, and a repeated batch is put once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start(stream: DataFrame, store, checkpoint: str, **trigger) -> StreamingQuery:
    """stream: key, value, and ord where a batch may hold a key twice. The store remembers the last batch of each
    checkpoint, so that a batch that was put before a failure isn't put again after it."""

    def append(batch: DataFrame, batch_id: int) -> None:
        store.put(batch, source=checkpoint, source_batch=batch_id)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
