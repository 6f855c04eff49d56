"""Inputs that queries derive from the driver's tables; SQL has the same as common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows over the documents as chunks of manuals."""
    from evspark.operators import ingest

    cut = ingest.chunk_fixed(documents(spark, sf_dir), 800, 120, keep=("lang", "source"))
    return cut.select(
        F.concat_ws("-", "doc_id", "index").alias("chunk_id"), "doc_id", F.concat(F.lit("manual "), F.col("doc_id") % 50).alias("doc_title"),
        F.when(F.col("doc_id") % 10 != 0, F.concat(F.lit("V"), F.col("doc_id") % 4)).alias("version"), F.col("lang").alias("category"), F.col("source").alias("device_model"),
        (F.floor(F.col("index") / 3) + 1).cast("int").alias("page"), (F.col("index") % 3).cast("string").alias("section"), F.lit("").alias("heading"), "index", "text",
    )


#: The same chunks in SQL.
CHUNKS = """cut AS (SELECT doc_id, lang, source, text, unnest(range(0, greatest(0, ceil((length(text) - 800) / 680.0))::INT + 1)) AS i FROM documents WHERE length(text) > 0),
chunks AS (SELECT doc_id || '-' || i AS chunk_id, doc_id, 'manual ' || (doc_id % 50) AS doc_title, CASE WHEN doc_id % 10 <> 0 THEN 'V' || (doc_id % 4) END AS version,
  lang AS category, source AS device_model, (i // 3 + 1)::INT AS page, (i % 3)::VARCHAR AS section, '' AS heading, i::INT AS index, substr(text, i * 680 + 1, 800) AS text FROM cut)"""


def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, with a heading for every seventh and a page mark for every twentieth."""
    from evspark.operators import ingest

    lines = ingest.explode_lines(documents(spark, sf_dir))
    line = F.when(F.col("pos") % 7 == 0, F.concat_ws("", F.lit("## "), F.expr("cast(pos div 7 + 1 AS string)"), F.lit("."), (F.col("doc_id") % 5).cast("string"), F.lit(" Part ")))
    line = line.when(F.col("pos") % 20 == 3, F.concat(F.lit("<!-- page: "), F.expr("cast(pos div 20 + 1 AS string)"), F.lit(" -->"))).otherwise(F.col("line"))
    return lines.withColumn("line", line)


LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)"
MARKED = f"""{LINES},
marked AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN '## ' || (pos // 7 + 1) || '.' || (doc_id % 5) || ' Part ' WHEN pos % 20 = 3 THEN '<!-- page: ' || (pos // 20 + 1) || ' -->' ELSE line END AS line FROM lines),
seen AS (SELECT *, nullif(regexp_extract(line, '<!-- page: ([0-9]+) -->', 1), '') AS mark, nullif(regexp_extract(line, '^#+ ([0-9.]+)', 1), '') AS number, regexp_matches(line, '^#{{2,4}}([^#]|$)') AS is_heading FROM marked),
filled AS (SELECT doc_id, pos, coalesce(last_value(mark IGNORE NULLS) OVER w, '1')::INT AS page, coalesce(last_value(CASE WHEN is_heading THEN number END IGNORE NULLS) OVER w, '') AS section,
  coalesce(last_value(CASE WHEN is_heading THEN 'Part' END IGNORE NULLS) OVER w, '') AS heading, line, mark, is_heading FROM seen WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
placed AS (SELECT doc_id, pos, page, section, heading, line FROM filled WHERE mark IS NULL AND NOT is_heading)"""
