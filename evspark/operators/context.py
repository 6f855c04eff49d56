"""From ranked evidence to numbered context and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.config import DEFAULT
from evspark.functions import text as fx

SOURCE_TYPES = ["document", "ticket", "image"]


def dedupe_keep_first(df: DataFrame, key: str = "chunk_id", by: str = "query_id", pos: str = "pos") -> DataFrame:
    """The first row of each key of a query."""
    w = Window.partitionBy(by, key).orderBy(pos)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def prefer_newer(df: DataFrame, by: str = "query_id", pos: str = "pos") -> DataFrame:
    """Of rows of one title and section, the one of the highest version (number by number), in the place of the first of them; rows without either come after all others. `pos` counts anew from 1."""
    keyed = (F.coalesce("doc_title", F.lit("")) != "") & (F.coalesce("section", F.lit("")) != "")
    w = Window.partitionBy(by, "doc_title", "section")
    ranked = df.withColumn("__keyed", keyed).withColumn("__first", F.when(keyed, F.min(pos).over(w)).otherwise(F.col(pos)))
    newest = F.row_number().over(Window.partitionBy(by, "__keyed", F.when(keyed, F.col("doc_title")), F.when(keyed, F.col("section")), F.when(~keyed, F.col(pos))).orderBy(F.desc(fx.version_key("version")), pos))
    kept = ranked.withColumn("__n", newest).filter("__n = 1")
    order = Window.partitionBy(by).orderBy(F.desc("__keyed"), "__first")
    return kept.withColumn(pos, F.row_number().over(order)).drop("__keyed", "__first", "__n")


def build_context(ranked: DataFrame, budget: int = DEFAULT.context_budget, by: str = "query_id", pos: str = "pos") -> DataFrame:
    """Rows in the budget of tokens, numbered: adds n (from 1), header, cost, cum. The first row always stays, and the rest is the longest prefix."""
    rows = dedupe_keep_first(prefer_newer(ranked, by, pos), "chunk_id", by, pos)
    order = Window.partitionBy(by).orderBy(pos)
    n = F.row_number().over(order)
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" 章节 "), F.col("section"))).otherwise(F.lit(""))
    rows = rows.withColumn("n", n).withColumn("header", F.concat_ws("", F.lit("["), F.col("n").cast("string"), F.lit("] 《"), F.col("doc_title"), F.lit("》 "), F.coalesce("version", F.lit("")), F.lit(" 第 "), F.col("page").cast("string"), F.lit(" 页"), section))
    rows = rows.withColumn("cost", fx.estimate_tokens("header") + fx.estimate_tokens("text"))
    rows = rows.withColumn("cum", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("n") == 1) | (F.col("cum") <= budget))


def context_text(blocks: DataFrame, by: str = "query_id") -> DataFrame:
    """query, blocks, context (headers and texts in order)."""
    joined = F.expr("listagg(concat(header, '\n', text), '\n\n') WITHIN GROUP (ORDER BY n)")
    return blocks.groupBy(by).agg(F.count(F.lit(1)).alias("blocks"), joined.alias("context"))


def to_citations(blocks: DataFrame, by: str = "query_id") -> DataFrame:
    """query, citations: an array in order of n; source types other than the known are documents, empty values null, snippets of 300 characters."""
    empty = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    kind = F.when(F.col("source_type").isin(SOURCE_TYPES), F.col("source_type")).otherwise(SOURCE_TYPES[0]).alias("source_type")
    one = F.struct("n", "chunk_id", empty("doc_title"), empty("version"), "page", empty("section"), kind, F.substring("text", 1, 300).alias("snippet"))
    return blocks.groupBy(by).agg(F.sort_array(F.collect_list(one)).alias("citations"))  # as many as the context has blocks
