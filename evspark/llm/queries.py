"""Queries op1 to op13 and the pipeline over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm import arrow_sequences, bpe, chat_format, exact_dedup, langid, line_dedup, mixing, ngram_join, quality_qda, quality_rules, token_align, turn_repair, warc_fixity
from evspark.llm.common import new_folder, table, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=85)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = "crc32(cast(doc_id AS string)) % 4 = 2"
    model = langid.train(langid.sample(docs, f"NOT ({held_out})"))
    return langid.label(docs.withColumn("held_out", F.expr(f"coalesce({held_out}, true)")), model, extra=("held_out",), spans=False)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_qda.score_quality(table(spark, sf_dir, "documents"), labels, "crc32(cast(doc_id AS string)) % 5 = 0")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return arrow_sequences.write_and_read(spark, docs, tokenizer("word_bpe_49k.json"), 2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC files in two replicas; the second is given damage in about 1.6 % of its records, which the audit is to find."""
    primary, replica = new_folder(spark, "warc"), new_folder(spark, "warc-replica")
    index = warc_fixity.write(table(spark, sf_dir, "pages"), primary, int(spark.conf.get("spark.sql.shuffle.partitions")), "2024-01-01T00:00:00Z")
    warc_fixity.copy_replica(index, primary, replica, "substring(md5(cast(page_id AS string)), 1, 2) < '04'")
    return warc_fixity.audit(index, primary, replica).select("page_id", "record_length", "record_sha256", "intact")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts have the template's marks in them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], turns.schema)
    return chat_format.digest(turns.unionByName(more))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.score_alignment(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_mixing, op4_ngram_join, op5_quality_rules, op6_language_id, op7_quality_classifier, op8_token_files, op9_warc_fixity, op10_exact_dedup, op11_chat_format, op12_turn_repair, op13_token_align, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op5_quality_rules": quality_rules.SQL, "op9_warc_fixity": warc_fixity.SQL, "op10_exact_dedup": exact_dedup.SQL}
