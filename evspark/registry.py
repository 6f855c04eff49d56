"""Queries of the core library over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evspark.suite import answers, business, files, ingest, plans, retrieval, streams

Query = Callable[[SparkSession, str], DataFrame]
_ALL = {k: v for m in (ingest, retrieval, answers, business, plans, streams, files) for k, v in m.QUERIES.items()}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ALL.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["r2_bm25_search"](spark, sf_dir)
