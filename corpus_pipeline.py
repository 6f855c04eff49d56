"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of `docs`; all but the last return the columns of `documents`. run()
writes what a stage returns as Parquet in the shared folder and reads it again for the next one. A stage removes what the one before
had put aside, so its result has to be written before another stage begins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm import bpe, common, langid, line_dedup, mixing, ngram_join
from evspark.llm.common import remove, table, tokenizer, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _frees_the_last(stage: Stage) -> Stage:
    """A stage begins when the result of the one before has been written: the tables that it was made of go then."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            remove(spark, _left.pop())
        before = len(common.FOLDERS)
        out = stage(spark, docs, sf_dir)
        _left.extend(common.FOLDERS[before:])
        return out

    return run


@_frees_the_last
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language can't be told, go."""
    return langid.keep_identified(docs, langid.train(langid.sample(docs, "true")))


@_frees_the_last
def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template an earlier document has go; the documents stay, with the lines that are left."""
    return _measured(line_dedup.drop_recurring(docs, counts=False), docs)


@_frees_the_last
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingles link at a similarity of 0.8, the one with the least id stays."""
    return ngram_join.drop_near_duplicates(docs)


@_frees_the_last
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document has the words that the mix takes of it; those of which it takes none are not in the mix."""
    return _measured(mixing.mixed_documents(docs), docs)


@_frees_the_last
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (packed little-endian unsigned 32-bit)."""
    return bpe.round_trip(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), keep_ids=True)


def _measured(out: DataFrame, docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now, in the type it had."""
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the Viterbi labels, the permutations and the merges; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
