"""Queries of streaming jobs: a table's file as a stream of files, taken to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.operators import ingest
from evspark.operators.parts import STEPS
from evspark.sources.index import reject_reason
from evspark.sources.store import Store, shared_folder
from evspark.streaming import tables
from evspark.suite.inputs import CHUNKS, table


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream, be it one file or a folder of files. The path is a pattern of one match, as a plain path must be a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def _folders(spark, name: str) -> tuple[str, str]:
    """Folders of a store and of the stream's checkpoint."""
    home = shared_folder(spark, name)
    return f"{home}/store", f"{home}/checkpoint"


def _stats(s, sf):
    c = _stream(s, sf, "conversations").filter("role = 'user'").select(F.col("text").alias("question"), F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 60).alias("created_at"))
    path, checkpoint = _folders(s, "stats")
    return tables.finished(s, tables.run_question_stats(c, path, checkpoint), path, "stats")


def _latency(s, sf):
    e = _stream(s, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")
    return tables.run_to_store(tables.stream_latency(e, "6 hours", "10 minutes"), *_folders(s, "latency"), "complete")


def _first(s, sf):
    kind = F.when(F.col("event_type") == "view", "start").when(F.col("event_type") == "click", "token").otherwise(F.col("event_type"))
    e = _stream(s, sf, "events").select(F.concat_ws("-", F.lit("t"), F.col("event_id") % 97).alias("trace_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("event_type"))
    return tables.run_to_store(tables.stream_first_event(e), *_folders(s, "first"), "complete")


ACTIONS = {"view": "submit", "signup": "approve", "click": "receive", "error": "reject", "purchase": "cancel"}


def order_events(events: DataFrame) -> DataFrame:
    """Events as steps of orders; every second rejection gives a reason."""
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("event_type"))
    reason = F.when(F.col("event_id") % 4 == 0, "wrong part").when(F.col("event_id") % 4 == 1, "cancelled by the buyer")
    return events.select((F.col("event_id") % 301).cast("long").alias("order_id"), F.col("event_id").cast("long").alias("seq"), action.alias("action"), reason.alias("reason"))


def _status(s, sf):
    """Where orders stand, with the number of their illegal steps."""
    path, checkpoint = _folders(s, "status")
    status = tables.finished(s, tables.run_order_status(order_events(_stream(s, sf, "events")), path, checkpoint), path, "status")
    illegal = Store(s, path).table("illegal").groupBy("order_id").agg(F.count(F.lit(1)).alias("illegal"), F.sum("seq").alias("illegal_seqs"))
    return status.join(illegal, "order_id", "left").select("order_id", "status", F.coalesce("illegal", F.lit(0)).alias("illegal"), F.coalesce("illegal_seqs", F.lit(0)).alias("illegal_seqs"))


def _ingest(s, sf):
    """Documents as a stream of files; those without a letter go to the quarantine."""
    path, checkpoint = _folders(s, "ingest")
    files = _stream(s, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", "text")

    def pipeline(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        judged = reject_reason(batch.withColumn("text", F.when(F.col("text").rlike("[A-Za-z]"), F.col("text"))))
        chunks = ingest.chunk_fixed(judged.filter("reason IS NULL"), 800, 120).select(F.concat_ws("-", "doc_id", "index").alias("chunk_id"), "doc_id", "index", "text")
        return chunks, judged.filter("reason IS NOT NULL").select("path", "reason")

    chunks = tables.finished(s, tables.stream_ingest(files, pipeline, path, checkpoint), path, "chunks")
    kept = chunks.select(F.col("doc_id").cast("string").alias("path"), F.col("index"), F.md5("text").alias("md5"), F.lit("ok").alias("reason"))
    return kept.unionByName(Store(s, path).table("quarantine").select("path", F.lit(-1).alias("index"), F.lit("").alias("md5"), "reason"))


QUERIES = {
    "x1_stream_question_stats": (_stats, r"""WITH k AS (SELECT substr(regexp_replace(lower(text), '[\s，。？！、；：,.?!;:"''（）()\[\]【】《》<>「」『』~～\-—_]+', '', 'g'), 1, 120) AS question_key, TIMESTAMP '2024-01-01' + to_minutes(conv_id::INT) AS t FROM conversations WHERE role = 'user')
      SELECT question_key, count(*) AS ask_count, min(t) AS first_asked_at, max(t) AS last_asked_at FROM k WHERE question_key <> '' GROUP BY 1"""),
    "x2_stream_ingest": (_ingest, f"""WITH {CHUNKS} SELECT doc_id::VARCHAR AS path, index, md5(text) AS md5, 'ok' AS reason FROM chunks WHERE doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z]'))
      UNION ALL SELECT doc_id::VARCHAR, -1, '', 'no text' FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[A-Za-z]')"""),
    "x3_stream_order_status": (_status, f"""WITH RECURSIVE e AS (SELECT event_id % 301 AS order_id, event_id AS seq, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTIONS.items())} END AS a, event_id % 4 AS r FROM events),
      s AS (SELECT order_id, seq, CASE WHEN a = 'reject' AND r = 1 THEN 'cancel' WHEN a = 'reject' AND r > 1 THEN 'refused' ELSE a END AS did, row_number() OVER (PARTITION BY order_id ORDER BY seq) AS n FROM e),
      t(status, did, after) AS (VALUES {', '.join(f"('{a}', '{b}', '{c}')" for (a, b), c in STEPS.items())}),
      w AS (SELECT order_id, 0::BIGINT AS n, 'draft' AS status, 0::BIGINT AS illegal, 0::HUGEINT AS seqs FROM s GROUP BY 1
        UNION ALL SELECT s.order_id, s.n, coalesce(t.after, w.status), w.illegal + (t.after IS NULL)::BIGINT, w.seqs + CASE WHEN t.after IS NULL THEN s.seq ELSE 0 END FROM w JOIN s ON s.order_id = w.order_id AND s.n = w.n + 1 LEFT JOIN t ON t.status = w.status AND t.did = s.did)
      SELECT order_id, arg_max(status, n) AS status, max(illegal) AS illegal, max(seqs)::BIGINT AS illegal_seqs FROM w GROUP BY 1"""),
    "x4_stream_first_event": (_first, """WITH e AS (SELECT 't-' || (event_id % 97) AS trace_id, ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'click' THEN 'token' ELSE event_type END AS k FROM events),
      g AS (SELECT trace_id, min(ts) FILTER (k = 'start') AS asked_at, min(ts) FILTER (k = 'token') AS first_at, max(ts) AS last_at FROM e GROUP BY 1)
      SELECT trace_id, asked_at, first_at, (epoch_us(first_at) - epoch_us(asked_at)) // 1000 AS first_ms, (epoch_us(last_at) - epoch_us(asked_at)) // 1000 AS total_ms FROM g"""),
    "x4_stream_latency": (_latency, "SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
}
