"""Readers and writers of the job's files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GOLDEN = "id string, question string, category string, device_model string, answer_points array<string>, must_cite array<string>, negative boolean, expect string, note string, allow_external_sources boolean"
TICKETS = "ticket_no string, device_model string, symptom string, root_cause string, action string, parts_used array<string>, conclusion string, date date, related_doc string"
PARTS = "part string, code string, price_cny decimal(18,2), supplier string, device_model string, spec string, stock int, unit string, location string, lead_time_days int, substitutes array<struct<part: string, code: string, basis: string>>, forbidden array<struct<part: string, reason: string>>"
GLOSSARY = "canonical string, kind string, ordinal int, synonyms array<string>"
ROUNDS = "rounds array<struct<concurrency: int, n_ok: int, n_failed: int, error_rate: double, wall_s: double, total_p50_s: double, total_p95_s: double, verdict: string>>"


@F.pandas_udf(StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    def one(b: bytes) -> str:
        for encoding in ("utf-8-sig", "gb18030"):
            try:
                return b.decode(encoding)
            except UnicodeDecodeError:
                continue
        return b.decode("utf-8", "ignore")

    return raw.map(one)


def scan_corpus(spark: SparkSession, path: str, decode: bool = True) -> DataFrame:
    """path, length, modificationTime and text of the .md, .markdown and .txt files below `path`, hidden ones left out: UTF-8, else GB18030, else what of it is UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.lower("path").rlike(r"\.(md|markdown|txt)$"))
    files = files.filter(~F.col("path").rlike(r"/\.[^/]+$"))
    plain = F.decode("content", "utf-8")
    return files.select("path", "length", "modificationTime", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.regexp_replace(plain, r"^\x{FEFF}", "")).otherwise(_decoded("content")).alias("text")) if decode else files


def read_golden(spark: SparkSession, path: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(GOLDEN).json(path).withColumn("negative", F.coalesce("negative", F.lit(False)))
    rows = rows if ids is None else rows.filter(F.col("id").isin(ids))
    return rows if limit is None else rows.orderBy("id").limit(limit)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as path, line (the text), row (a struct of `schema`) and corrupt (the line, if it is not an object of these types; row is then null). Empty lines are left out; a missing file is an empty table."""
    try:
        lines = spark.read.text(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        lines = spark.createDataFrame([], "value string")
    lines = lines.select(F.col("_metadata.file_path").alias("path") if lines.inputFiles() else F.lit(None).cast("string").alias("path"), F.col("value").alias("line")).filter("trim(line) != ''")
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    wrong = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.col("line").rlike(r"^\s*\{")
    return parsed.select("path", "line", F.when(~wrong, F.col("row").dropFields("_corrupt")).alias("row"), F.when(wrong, F.col("line")).alias("corrupt"))


def read_reference(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A reference table (TICKETS, PARTS, GLOSSARY) from JSON lines. Lines that don't parse are kept apart: `read_corrupt`. A missing file is an empty table."""
    return read_lines(spark, path, schema).filter("corrupt IS NULL").select("row.*")


def read_corrupt(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, line: the lines of a reference table that don't parse."""
    return read_lines(spark, path, schema).filter("corrupt IS NOT NULL").select("path", "line")


def write_report(rows: DataFrame, path: str) -> None:
    """A report as one JSON-lines file; for summaries and items of an evaluation."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def read_load_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row a round of multi-line JSON reports."""
    return spark.read.schema(ROUNDS).option("multiLine", True).json(path).select(F.explode("rounds").alias("r")).select("r.*")
