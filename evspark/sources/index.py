"""The index as written tables: chunks, the documents they are of, and the documents that gave none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.functions import text as fx
from evspark.operators import ingest
from evspark.sources.store import PARTS, Change, Store

META = "provider string, model string, signature string, dim int, version long, updated_at string"


def _meta(provider: str, model: str, dim: int) -> dict:
    return {"provider": provider, "model": model, "signature": f"{provider}:{model}", "dim": dim}


def write_index(chunks: DataFrame, path: str, provider: str, model: str, dim: int, mode: str = "overwrite", key: str = "chunk_id", parts: int = PARTS) -> dict:
    """Write chunks as a new version: all that there is ('overwrite'), or in place of those of the same ids ('upsert'). An index takes vectors of one signature: an upsert of another is refused."""
    store = Store(chunks.sparkSession, path)
    meta, held = _meta(provider, model, dim), store.manifest()["meta"].get("signature")
    if mode == "upsert" and held not in (None, meta["signature"]):
        raise ValueError(f"the index holds vectors of {held}, not of {meta['signature']}")
    return store.change({"chunks": Change(chunks, mode, key, parts)}, meta)


def read_index(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The chunks of the last whole version, or of another."""
    chunks = Store(spark, path).table("chunks", version)
    if chunks is None:
        raise ValueError(f"no index at {path}")
    return chunks


def read_failures(spark: SparkSession, path: str) -> DataFrame | None:
    """doc_id, reason: documents that the last rebuild could not take."""
    return Store(spark, path).table("failures")


def index_manifest(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row: provider, model, signature, dim, version, updated_at, n_chunks, n_documents. The documents themselves: `index_documents`."""
    m = Store(spark, path).manifest()
    row = spark.createDataFrame([(*(m["meta"].get(k) for k in ("provider", "model", "signature", "dim")), m["version"], m.get("written_at"))], META)
    counts = read_index(spark, path).agg(F.count(F.lit(1)).alias("n_chunks"), F.countDistinct(id_col).alias("n_documents"))
    return row.crossJoin(counts)  # one row each


def index_documents(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """The index's documents, each once, in order, with the number of their chunks."""
    return read_index(spark, path).groupBy(id_col).agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(id_col)


def reject_reason(docs: DataFrame, text_col: str = "text", required: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with `reason`: null, 'no text', or 'missing' and the names of the required columns that are empty."""
    lacks = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required])), ", ")
    no_text = fx.trimmed(F.coalesce(F.col(text_col), F.lit(""))) == ""
    return docs.withColumn("reason", F.when(no_text, "no text").when(lacks != "", F.concat(F.lit("missing "), lacks)))


def rebuild_index(docs: DataFrame, chunker: Callable[[DataFrame], DataFrame], path: str, provider: str, model: str, dim: int, mode: str = "overwrite", required: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunk `docs` and write the index anew ('overwrite') or beside what it has ('append'); gives doc_id, n_chunks, status, reason.

    A document without text or required metadata, or of which `chunker` makes no chunk, is a row of the failures and does not stop
    the others; if it had failed before and is taken now, that row goes. Chunks and failures change in one step: a job that ends
    before it leaves the index as it was.
    """
    spark, store = docs.sparkSession, Store(docs.sparkSession, path)
    if mode not in ("overwrite", "append"):
        raise ValueError(mode)
    meta, held = _meta(provider, model, dim), store.manifest()["meta"].get("signature")
    if mode == "append" and held not in (None, meta["signature"]):
        raise ValueError(f"the index holds vectors of {held}, not of {meta['signature']}")
    judged = reject_reason(docs, text_col, required)
    staging = Store(spark, f"{path}/staging")  # chunks are made once: for the index, the failures and the report
    staging.change({"chunks": Change(chunker(judged.filter("reason IS NULL").drop("reason")))})
    chunks = staging.table("chunks")
    counts = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    report = judged.select(id_col, "reason").join(counts, id_col, "left").select(id_col, F.coalesce("n", F.lit(0)).alias("n_chunks"), F.when(F.col("n").isNull(), F.coalesce("reason", F.lit("no chunks"))).alias("reason"))
    staging.change({"report": Change(report)})
    report = staging.table("report")
    failed = report.filter("reason IS NOT NULL").select(id_col, "reason")
    before = store.table("failures")
    if mode == "append" and before is not None:
        failed = before.join(report.select(id_col), id_col, "left_anti").unionByName(failed)
    store.change({"chunks": Change(chunks, "upsert" if mode == "append" else "overwrite", "chunk_id"), "failures": Change(failed)}, meta)
    return report.select(id_col, "n_chunks", F.when(F.col("reason").isNull(), "ok").otherwise("failed").alias("status"), "reason")


def drop_documents(spark: SparkSession, path: str, ids: DataFrame, id_col: str = "doc_id") -> dict:
    """The index without the documents of `ids`, as a new version."""
    return Store(spark, path).change({"chunks": Change(ingest.delete_documents(read_index(spark, path), ids, id_col), key="chunk_id")})
