"""Jobs that keep tables current; each gives what its batch twin gives on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evspark.functions import text as fx
from evspark.operators.parts import STEPS, step_action
from evspark.sources.store import Change, Store
from evspark.streaming import sinks

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_question_stats(log: DataFrame) -> DataFrame:
    """question_key, ask_count, first_asked_at, last_asked_at, kept up to date (complete or update mode)."""
    keyed = log.withColumn("question_key", fx.normalize_question("question")).filter("question_key != ''")
    return keyed.groupBy("question_key").agg(F.count(F.lit(1)).alias("ask_count"), F.min("created_at").alias("first_asked_at"), F.max("created_at").alias("last_asked_at"))


def run_question_stats(log: DataFrame, path: str, checkpoint: str):
    """Keep the table `stats` of a store: each batch brings the new state of the questions asked in it, which takes the place of the old."""
    return sinks.run(stream_question_stats(log), path, checkpoint, lambda rows: {"stats": Change(rows, "upsert", "question_key")}, "update")


def stream_latency(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, n, errors, mean: by tumbling window of `ts`; rows later than the watermark are left out. `events`: ts (TIMESTAMP), value, event_type."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("errors"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("window.start").alias("start"), "n", "errors", "mean")


def stream_first_event(events: DataFrame, late: str = "10 minutes", says: str = "token") -> DataFrame:
    """trace_id, asked_at, first_at, first_ms, total_ms: of each trace, from its `start` event to its first event of type `says` and to its last event. `events`: trace_id, ts (TIMESTAMP), event_type. Null where a trace has no such event."""
    by = events.withWatermark("ts", late).groupBy("trace_id").agg(F.min(F.when(F.col("event_type") == "start", F.col("ts"))).alias("asked_at"), F.min(F.when(F.col("event_type") == says, F.col("ts"))).alias("first_at"), F.max("ts").alias("last_at"))
    since = lambda c: F.timestamp_diff("MILLISECOND", F.col("asked_at"), F.col(c))
    return by.select("trace_id", "asked_at", "first_at", since("first_at").alias("first_ms"), since("last_at").alias("total_ms"))


class OrderSteps(StatefulProcessor):
    """The state of an order is its status. Each step comes out with the status after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status = self.status.get()[0] if self.status.exists() else "draft"
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():  # an order's steps of one batch
            to = STEPS.get((status, row.did))
            status = to or status
            out.append((key[0], row.seq, row.action, status, to is not None))
        self.status.update((status,))
        yield pd.DataFrame(out, columns=["order_id", "seq", "action", "status", "legal"])

    def close(self) -> None:
        pass


def stream_order_status(events: DataFrame) -> DataFrame:
    """order_id, seq, action, status, legal: each step of events (order_id, seq, action and, if there are reasons, reason) with the status after it. Within a batch an order's steps go by `seq`, and batches go in order of arrival. State is kept by RocksDB."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    did = step_action() if "reason" in events.columns else F.col("action")
    steps = events.select("order_id", "seq", "action", did.alias("did"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("order_id", "seq")}
    return steps.groupBy("order_id").transformWithStateInPandas(OrderSteps(), f"order_id {kinds['order_id']}, seq {kinds['seq']}, action string, status string, legal boolean", "append", "none")


def run_order_status(events: DataFrame, path: str, checkpoint: str):
    """Two tables of a store: `status` (order_id, seq, status: where each order stands after its last legal step) and `illegal` (order_id, seq, action, status: steps that the status before does not allow)."""

    def changes(rows: DataFrame) -> dict[str, Change]:
        last = rows.groupBy("order_id").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"))
        return {"status": Change(last, "upsert", "order_id"), "illegal": Change(rows.filter("NOT legal").drop("legal"), "append")}

    return sinks.run(stream_order_status(events), path, checkpoint, changes)


def stream_ingest(files: DataFrame, pipeline: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str, checkpoint: str, key: str = "chunk_id"):
    """Keep the tables `chunks` and `quarantine` of a store. `pipeline` makes of a batch of files their chunks, which take the place of those of equal `key`, and the files it can't take (path, reason). A path leaves the quarantine when a later batch has taken it."""

    def changes(batch: DataFrame) -> dict[str, Change]:
        chunks, failed = pipeline(batch)
        before = Store(batch.sparkSession, path).table("quarantine")
        held = failed if before is None else before.join(batch.select("path").distinct(), "path", "left_anti").unionByName(failed)
        return {"chunks": Change(chunks, "upsert", key), "quarantine": Change(held)}

    return sinks.run(files, path, checkpoint, changes)


def finished(spark: SparkSession, query, path: str, name: str) -> DataFrame:
    """Wait for the end of a query, and read a table of its store."""
    query.awaitTermination()
    return Store(spark, path).table(name)


def run_to_store(stream: DataFrame, path: str, checkpoint: str, mode: str) -> DataFrame:
    """Take all that is there into the table `rows` of a store: in complete mode all of it anew with each batch, in append mode added."""
    kind = "overwrite" if mode == "complete" else "append"
    return finished(stream.sparkSession, sinks.run(stream, path, checkpoint, lambda rows: {"rows": Change(rows, kind)}, mode), path, "rows")


def run_to_table(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Take all that is there into a table in the driver's memory: for tests and small results only."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
