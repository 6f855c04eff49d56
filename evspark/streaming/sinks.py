"""Sinks of streams: tables of a store in the shared folder. A batch that is replayed, by a restart or a lost checkpoint entry, changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from evspark.sources.store import Change, Store


def query_id(batch: DataFrame) -> str | None:
    """The id of the running stream, which its checkpoint keeps over restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def store_sink(path: str, changes: Callable[[DataFrame], dict[str, Change]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: all tables that `changes` names of a batch change in one step, together with the number of the batch."""

    def save(batch: DataFrame, number: int) -> None:
        store, stream = Store(batch.sparkSession, path), query_id(batch) or "stream"
        if store.has_batch(stream, number):
            batch.write.format("noop").mode("overwrite").save()  # its rows are in, but the states that it leaves have to be kept too
            return
        batch.persist()  # one batch, read once for each table
        try:
            store.change(changes(batch), stream=stream, batch=number)
        finally:
            batch.unpersist()

    return save


def run(stream: DataFrame, path: str, checkpoint: str, changes: Callable[[DataFrame], dict[str, Change]], mode: str = "append", **options: str):
    """Start a query that takes all that is there and ends."""
    return stream.writeStream.outputMode(mode).foreachBatch(store_sink(path, changes)).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
