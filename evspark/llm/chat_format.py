"""Conversations as text for training: one example for each assistant turn, with all turns before it as context.

A turn is written as `### Role: text</turn>` and a line end. In texts a backslash follows each backslash, and each first character of
what would be a mark, so that `###` and `</turn>` are in the output as marks alone and every text can be had back. Examples share their
contexts: the formatted turns are stored once, and an example is a prefix of its conversation's text with the span of its reply. So
the output grows with the turns and not with the square of a conversation's length; `example_texts` makes whole texts of examples.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from evspark.llm.common import new_folder
from evspark.llm.turns import by_conversation, in_order

BEGIN, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Roles that are written with a capital; any other stands after `=`.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
_TURN = re.compile(r"### (=?)((?:[^\\:]|\\.)*): (.*)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLES = {v: k for k, v in NAMES.items()}


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|#(?=##)|<(?=/turn>)", r"$0\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for k, v in NAMES.items():
        known = F.when(role == k, v).otherwise(known)
    return F.concat(F.lit(BEGIN), F.coalesce(known, F.concat(F.lit("="), F.regexp_replace(role, r"[\\:#<\n]", r"\\$0"))), F.lit(MIDDLE))


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    other, role, text = found.groups()
    return unescape(role) if other else _ROLES[role], unescape(text)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, at, start, formatted, reply_at, reply_chars: the turns of each conversation in order, each with its place in the conversation's text, and in it the reply of an assistant (null for others).

    Null roles and texts count as empty. Turns without a number come first; those that share a number stand by role and text. A null
    id is a conversation. Other columns do not matter; an empty table gives an empty one.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    made = rows.withColumns({"head": header(F.col("role")), "body": escaped(F.col("text")), "tie": F.xxhash64("role", "text")})
    made = made.select("conv_id", "turn", "tie", "role", "text", F.concat("head", "body", F.lit(END)).alias("formatted"), F.length("head").alias("head"), F.length("body").alias("body"))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("tie"), F.asc("text")]
    replies = F.col("role") == "assistant"
    marked = made.select("conv_id", "turn", "role", "tie", "text", "formatted", F.when(replies, F.col("head")).alias("reply_at"), F.when(replies, F.col("body")).alias("reply_chars"))
    placed = in_order(marked, "conv_id", order, F.length("formatted"), "turns")
    return placed.select("conv_id", "at", "start", "formatted", F.col("reply_at").cast("long"), F.col("reply_chars").cast("long"))


def write(turns: DataFrame, folder: str, **names: str) -> tuple[DataFrame, DataFrame]:
    """Write and read again `turns` (conv_id, at, start, formatted) and `examples`, one row for each assistant turn: conv_id, at (its turn), context_chars, loss_start, loss_end (places in the conversation's text; the mask is true between them)."""
    spark = turns.sparkSession
    made = format_turns(turns, **names)
    made.write.parquet(f"{folder}/formatted")
    own = spark.read.schema(made.schema).parquet(f"{folder}/formatted")
    where = F.col("start") + F.col("reply_at")
    examples = own.filter("reply_at IS NOT NULL").select("conv_id", "at", F.col("start").alias("context_chars"), where.alias("loss_start"), (where + F.col("reply_chars")).alias("loss_end"))
    examples.write.parquet(f"{folder}/examples")
    return own.select("conv_id", "at", "start", "formatted"), spark.read.schema(examples.schema).parquet(f"{folder}/examples")


def example_texts(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, at, context, reply of the given examples. Their whole contexts are written out, so take those that a reader needs at a time."""
    wanted = examples.select(F.col("conv_id").alias("of"), F.col("at").alias("target"), "context_chars", "loss_start", "loss_end")
    joined = wanted.join(formatted, F.expr("of <=> conv_id AND at <= target"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "formatted"))), lambda x: x["formatted"]), "")
    whole = joined.groupBy("of", "target", "context_chars", "loss_start", "loss_end").agg(text.alias("text"))
    cut = lambda lo, hi: F.substring(F.col("text"), lo.cast("int") + 1, (hi - lo).cast("int"))
    reply = F.regexp_replace(cut(F.col("loss_start"), F.col("loss_end")), r"(?s)\\(.)", "$1")
    return whole.select(F.col("of").alias("conv_id"), F.col("target").alias("at"), cut(F.lit(0), F.col("context_chars")).alias("context"), reply.alias("reply"))


def read_back(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """What the output says of each conversation: conv_id, n_turns, n_examples, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns are parsed, and replies are cut out by the spans of the examples and unescaped. A digest is a chain over a conversation's
    turns, which one task reads in order, a slice at a time.
    """
    spans = examples.select("conv_id", "at", F.lit(0).alias("kind"), F.col("loss_start").alias("lo"), F.col("loss_end").alias("hi"), F.lit(None).cast("string").alias("formatted"))
    rows = spans.unionByName(formatted.select("conv_id", "at", F.lit(1).alias("kind"), F.col("start").alias("lo"), F.lit(None).cast("long").alias("hi"), "formatted"))
    counts = ["n_turns", "n_examples", "loss_chars", "formatted_chars"]
    out = StructType([formatted.schema["conv_id"], *(StructField(c, LongType()) for c in counts), StructField("turns_sha256", StringType()), StructField("loss_sha256", StringType())])

    def work(told: Iterator[tuple[bool, dict]]) -> Iterator[tuple]:
        conv, n, turns, loss, span, any_row = None, [0] * 4, hashlib.sha256(), hashlib.sha256(), None, False
        for first, row in told:
            if first:
                if any_row:
                    yield (conv, *n, turns.hexdigest(), loss.hexdigest())
                conv, n, turns, loss, any_row = row["conv_id"], [0] * 4, hashlib.sha256(), hashlib.sha256(), True
            if row["kind"] == 0:
                span = (row["lo"], row["hi"])
                continue
            role, text = parse_turn(row["formatted"])
            turns.update(f"{role}\n{text}\n".encode())
            n[0] += 1
            n[3] += len(row["formatted"])
            if span:
                reply = unescape(row["formatted"][span[0] - row["lo"] : span[1] - row["lo"]])
                loss.update(reply.encode())
                n[1], n[2], span = n[1] + 1, n[2] + len(reply), None
        if any_row:
            yield (conv, *n, turns.hexdigest(), loss.hexdigest())

    return by_conversation(rows, ["at", "kind"], work, out)


def digest(turns: DataFrame) -> DataFrame:
    """Format, write, and read back."""
    return read_back(*write(turns, new_folder(turns.sparkSession, "chat")))
