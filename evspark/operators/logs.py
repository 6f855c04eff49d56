"""Analytics over question logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions import text as fx
from evspark.operators.lexical import top_k


def question_stats(log: DataFrame) -> DataFrame:
    """question_key, ask_count, first_asked_at, last_asked_at, sample (the first wording, 500 characters). `log`: id, question, created_at. Blank keys are left out; of equal times the smaller id is first."""
    keyed = log.withColumn("question_key", fx.normalize_question("question")).filter("question_key != ''")
    return keyed.groupBy("question_key").agg(
        F.count(F.lit(1)).alias("ask_count"), F.min("created_at").alias("first_asked_at"), F.max("created_at").alias("last_asked_at"),
        F.min_by(F.substring(fx.trimmed("question"), 1, 500), F.struct("created_at", "id")).alias("sample"),
    )


def top_questions(stats: DataFrame, n: int, min_count: int = 1) -> DataFrame:
    return stats.filter(F.col("ask_count") >= min_count).orderBy(F.desc("ask_count"), F.desc("last_asked_at"), "question_key").limit(n)


def session_overview(sessions: DataFrame, log: DataFrame, like: str | None = None) -> DataFrame:
    """session_id, title, created_at, messages (two for each record), last_question. Sessions without records stay."""
    per = log.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("question", F.struct("created_at", "id")).alias("last_question"))
    out = sessions.join(per, "session_id", "left").select("session_id", "title", "created_at", (2 * F.coalesce("n", F.lit(0))).alias("messages"), "last_question")
    return out if like is None else out.filter(F.col("title").contains(like))


def session_messages(log: DataFrame) -> DataFrame:
    """session_id, id, role, content: each record as the user's row and then the assistant's."""
    pair = F.array(F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("question").alias("content")), F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")))
    return log.select("session_id", "id", F.explode(pair).alias("m")).select("session_id", "id", F.col("m.k").alias("k"), F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def recent_history(log: DataFrame, n: int = 6) -> DataFrame:
    """The messages of each session's n latest records, without empty answers."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    last = log.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")
    return session_messages(last).filter((F.col("role") == "user") | (fx.trimmed(F.coalesce("content", F.lit(""))) != ""))


def feedback_badcases(feedback: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rejected answers with their question (answers cut to 300 characters), and feedback on records that are not there. `feedback`: id, qa_id, type, comment."""
    known = log.select(F.col("id").alias("qa_id"), "question", F.substring("answer", 1, 300).alias("answer"), "status")
    return feedback.filter("type = 'reject'").join(known, "qa_id").select("id", "qa_id", "question", "answer", "status", "comment"), feedback.join(known, "qa_id", "left_anti")


def request_gate(question: Column, n_images: Column, kind: Column, size: Column, width: Column, height: Column) -> Column:
    """Why a request is refused, or null: a question blank or over 2000 characters, over three images, or an image of a wrong type, over 5 MB or under 200 pixels."""
    q = fx.trimmed(F.coalesce(question, F.lit("")))
    return (
        F.when(q == "", "empty question").when(F.length(q) > 2000, "question too long").when(n_images > 3, "too many images").when((n_images > 0) & ~kind.isin("image/png", "image/jpeg", "image/webp"), "image type")
        .when((n_images > 0) & (size > 5 * 1024 * 1024), "image too large").when((n_images > 0) & (F.least(width, height) < 200), "image too small")
    )


def target_size(width: Column, height: Column, longest: int = 1600) -> Column:
    """Width and height scaled so that the longer side is `longest` at most."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale)).alias("width"), F.greatest(F.lit(1), F.floor(height * scale)).alias("height"))


__all__ = ["feedback_badcases", "question_stats", "recent_history", "request_gate", "session_messages", "session_overview", "target_size", "top_k", "top_questions"]
