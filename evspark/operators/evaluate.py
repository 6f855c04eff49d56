"""Evaluation of retrieval, citations, answers and load tests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from evspark.functions import text as fx
from evspark.operators import quantiles


def _has(point: str, text: str) -> bool:
    """Of normalised texts. A pair of the point is a pair of the text if it stands in it, so no pairs of the text are made."""
    if not point or point in text:
        return bool(point)
    pairs = {point[i : i + 2] for i in range(len(point) - 1)}  # one character alone has none, and would stand in the text
    return bool(pairs) and 2 * sum(x in text for x in pairs) >= len(pairs)


@F.pandas_udf(BooleanType())
def _hit(points: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([_has(p, t) for p, t in zip(points, texts, strict=True)], dtype=bool)


@F.pandas_udf(StructType([StructField("hit_answer", LongType()), StructField("hit_any", LongType())]))
def _hits(points: pd.Series, answers: pd.Series, evidence: pd.Series) -> pd.DataFrame:
    out = []
    for some, a, e in zip(points, answers, evidence, strict=True):
        own = [_has(p, a) for p in some]
        out.append((sum(own), sum(o or _has(p, a + e) for o, p in zip(own, some, strict=True))))
    return pd.DataFrame(out, columns=["hit_answer", "hit_any"], dtype="int64")


def point_hit(point: Column, text: Column) -> Column:
    """Whether a text has an answer point: as it is without punctuation, or half of its character pairs."""
    return _hit(fx.normalized(point), fx.normalized(text))


def retrieval_metrics(ranked: DataFrame, labels: DataFrame, k: int = 5, id_col: str = "chunk_id") -> DataFrame:
    """query_id, hit, rr, ndcg at k. `ranked`: query_id, chunk, rank; `labels`: query_id, chunk. The ideal order is that of the retrieved relevant rows. Queries without labels are left out."""
    rel = ranked.filter(F.col("rank") <= k).join(labels.select("query_id", id_col).distinct().withColumn("rel", F.lit(1)), ["query_id", id_col], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "rank")
    gains = rel.withColumn("ideal", F.row_number().over(w))
    gain = lambda at: F.sum(F.col("rel") / F.log2(F.col(at) + 1))
    per = gains.groupBy("query_id").agg(F.max("rel").alias("hit"), F.max(F.when(F.col("rel") == 1, 1 / F.col("rank")).otherwise(0.0)).alias("rr"), gain("rank").alias("dcg"), gain("ideal").alias("idcg"))
    asked = labels.select("query_id").distinct().join(per, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return asked.select("query_id", F.coalesce("hit", F.lit(0)).alias("hit"), zero(F.col("rr")).alias("rr"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"))


def answer_metrics(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """id, points, hit_answer, hit_any. `answers`: id, answer, evidence; `golden`: id, answer_points."""
    # texts are normalised once, not once a point; without punctuation, answer and evidence follow each other
    own = answers.select("id", fx.normalized("answer").alias("__answer"), fx.normalized("evidence").alias("__evidence"))
    none = lambda c: F.coalesce(c, F.lit(""))
    each = golden.filter(F.size("answer_points") > 0).select("id", F.transform("answer_points", fx.normalized).alias("__points")).join(own, "id", "left")
    counted = each.select("id", F.size("__points").alias("points"), _hits("__points", none("__answer"), none("__evidence")).alias("h"))
    return counted.groupBy("id").agg(F.sum("points").alias("points"), F.sum("h.hit_answer").alias("hit_answer"), F.sum("h.hit_any").alias("hit_any"))


def summarize_eval(items: DataFrame) -> DataFrame:
    """One row. `items`: id, negative, hit, rr, ndcg, citations, fakes, claims, cited_claims, coverage, points, hit_answer, hit_any, status."""
    pos, neg = ~F.col("negative"), F.col("negative")
    mean = lambda c, of: F.round(F.avg(F.when(of, c)), 6)
    ratio = lambda a, b: F.round(F.when(F.sum(F.when(pos, b)) > 0, F.sum(F.when(pos, a)) / F.sum(F.when(pos, b))).otherwise(1.0), 6)
    return items.agg(
        F.count(F.lit(1)).alias("items"), mean(F.col("hit"), pos).alias("hit_rate"), mean(F.col("rr"), pos).alias("mrr"), mean(F.col("ndcg"), pos).alias("ndcg"),
        mean(F.col("coverage"), pos & (F.col("claims") > 0)).alias("coverage"), F.sum((pos & (F.col("claims") == 0)).cast("long")).alias("vacuous"),
        ratio(F.col("citations") - F.col("fakes"), F.col("citations")).alias("citation_precision"), ratio(F.col("hit_answer"), F.col("points")).alias("points_strict"), ratio(F.col("hit_any"), F.col("points")).alias("points_loose"),
        mean((F.col("status") == "NOT_COVERED").cast("int"), neg).alias("negative_refusal"), F.sum((pos & (F.col("status") == "NOT_COVERED")).cast("long")).alias("false_refusals"),
    )


#: Targets of the metrics, and below them what still counts as degraded.
TARGETS = {"hit_rate": 0.80, "coverage": 1.0, "citation_precision": 0.95, "points_loose": 0.80, "negative_refusal": 0.90}


def verdicts(summary: DataFrame, targets: dict[str, float] = TARGETS, degraded: float = 0.9) -> DataFrame:
    """metric, value, target, verdict: met, degraded (nine tenths of the target) or failed."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("target")) for k, v in targets.items()]))
    v = summary.select(pairs.alias("x")).select("x.*")
    return v.withColumn("verdict", F.when(F.col("value") >= F.col("target"), "met").when(F.col("value") >= degraded * F.col("target"), "degraded").otherwise("failed"))


def exclusive_quantile(df: DataFrame, by: list[str], col: str, q: float = 0.95, least: int = 20) -> DataFrame:
    """by, n, value: the quantile at q (n + 1), interpolated; under `least` samples the maximum."""
    found = quantiles.quantiles(df, by, col, {"q": (q, quantiles.exclusive), "top": (1.0, quantiles.linear)})
    return found.select(*by, "n", F.round(F.when(F.col("n") >= least, F.col("q")).otherwise(F.col("top")), 6).alias("value"))


def golden_check(golden: DataFrame, sections: DataFrame, bare_points: bool = False) -> DataFrame:
    """id, problem. `golden`: id, question, answer_points, must_cite ("document#section"), negative, expect, note; `sections`: doc, section, text.

    A point without a letter or digit is in no section, or, with `bare_points`, in any that has a text.
    """
    say = lambda df, problem: df.select("id", F.lit(problem).alias("problem"))
    twice = golden.groupBy("id").count().filter("count > 1")
    empty = golden.filter(fx.trimmed(F.coalesce("question", F.lit(""))) == "")
    bare = golden.filter(F.col("negative") & (F.col("expect").isNull() | F.col("note").isNull()))
    pos = golden.filter(~F.col("negative"))
    unlabelled = pos.filter((F.size("must_cite") <= 0) | (F.size("answer_points") <= 0))
    named = sections.select(F.concat("doc", F.lit("#"), "section").alias("cite"), "text")  # not the parts of a cite, as a document's name may have a #
    gone = pos.select("id", F.explode("must_cite").alias("cite")).join(named.select("cite").distinct(), "cite", "left_anti")
    points = pos.select("id", "must_cite", F.posexplode("answer_points").alias("at", "point"))
    # a point meets the sections that its own item cites, not those of another item with the same id
    own = points.select("id", "at", "point", F.explode("must_cite").alias("cite")).join(named, "cite")
    hit = point_hit(F.col("point"), F.col("text"))
    if bare_points:
        hit = hit | ((fx.normalized("point") == "") & F.col("text").isNotNull())
    hits = own.select("id", "at", hit.cast("int").alias("hit")).groupBy("id", "at").agg(F.max("hit").alias("hit"))
    missed = points.join(hits.filter("hit = 1"), ["id", "at"], "left_anti").select("id").distinct()
    parts = [say(twice, "id repeated"), say(empty, "no question"), say(bare, "negative without expectation"), say(unlabelled, "positive without labels"), say(gone.select("id").distinct(), "cites what is not there"), say(missed, "point not in a cited section")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def golden_distribution(golden: DataFrame) -> DataFrame:
    """category, n, negatives, share of all."""
    total = golden.agg(F.count(F.lit(1)).alias("total"))
    per = golden.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("negative").cast("long")).alias("negatives"))
    return per.crossJoin(F.broadcast(total)).select("category", "n", "negatives", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def badcases(items: DataFrame) -> DataFrame:
    """id, why: positives without a hit, negatives that were answered, and any answer with a wrong citation."""
    why = F.when(F.col("fakes") > 0, "wrong citation").when(F.col("negative") & (F.col("status") != "NOT_COVERED"), "not refused").when(~F.col("negative") & ((F.col("hit") == 0) | (F.col("status") == "NOT_COVERED")), "failed")
    return items.select("id", why.alias("why")).filter("why IS NOT NULL")


def load_summary(requests: DataFrame, limit_s: float = 15.0) -> DataFrame:
    """round, ok, failed, error_rate, wall_s, p50, p95, verdict. `requests`: round, ok, started, seconds. Percentiles are linear."""
    counts = requests.groupBy("round").agg(
        F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum((~F.col("ok")).cast("long")).alias("n_failed"), F.round(F.avg((~F.col("ok")).cast("int")), 6).alias("error_rate"),
        F.round(F.max(F.col("started") + F.col("seconds")) - F.min("started"), 6).alias("wall_s"),
    )
    found = quantiles.quantiles(requests.filter("ok"), ["round"], "seconds", {"p50": (0.5, quantiles.linear), "p95": (0.95, quantiles.linear)})
    out = counts.join(found.select(F.col("round").alias("__of"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")), F.col("round").eqNullSafe(F.col("__of")), "left").drop("__of")
    return out.withColumn("verdict", F.when((F.col("n_failed") == 0) & (F.col("p95") <= limit_s), "within capacity").otherwise("over capacity"))


def worst_round(rounds: DataFrame) -> DataFrame:
    return rounds.agg(F.max_by(F.struct("round", "p95"), F.struct(F.coalesce("p95", F.lit(0.0)), F.col("round"))).alias("x")).select("x.*")


def run_length_events(events: DataFrame, by: str, order: list[str], name: str = "event") -> DataFrame:
    """by, path: event names in order, runs as name×count."""
    w = Window.partitionBy(by).orderBy(*order)
    new = (~F.col(name).eqNullSafe(F.lag(name).over(w))).cast("int")
    runs = events.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(by, "__run").agg(F.first(name).alias("e"), F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("n") > 1, F.concat_ws("", "e", F.lit("×"), F.col("n").cast("string"))).otherwise(F.col("e"))
    return runs.withColumn("part", part).groupBy(by).agg(F.expr("listagg(part, ' → ') WITHIN GROUP (ORDER BY __run)").alias("path"))


def image_eval(results: DataFrame, golden: DataFrame) -> DataFrame:
    """id, passed, reason. `golden`: id, expected (array), negative; `results`: id, extracted, status, answer."""
    each = golden.join(results, "id", "left")
    text = F.lower(F.coalesce("extracted", F.lit("")))
    missing = F.filter("expected", lambda x: ~text.contains(F.lower(x)))
    reason = F.when(F.col("status").isNull(), "no result").when(F.col("negative") & (F.col("status") != "NOT_COVERED"), "not refused").when(~F.col("negative") & (F.size(missing) > 0), F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return each.select("id", reason.isNull().alias("passed"), reason.alias("reason"))
