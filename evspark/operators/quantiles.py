"""Exact quantiles of groups of any size, by selection and not by sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups up to so many rows are ranked whole. In larger ones a sketch of relative error 1 / ACCURACY brackets the rank, with a margin of so many errors on both sides.
SMALL, ACCURACY, MARGIN = 10_000, 10_000, 4


def linear(q: float, n: Column) -> Column:
    """Rank (from 1, with a fraction) of the inclusive quantile."""
    return 1 + q * (n - 1)


def exclusive(q: float, n: Column) -> Column:
    return q * (n + 1)


def quantiles(df: DataFrame, by: list[str], col: str, wanted: dict[str, tuple[float, object]]) -> DataFrame:
    """by, n (rows with a value) and a column for each of `wanted` (name: share and rule of its rank): interpolated between the two values at the rank. Groups without a value have no row.

    First a sketch of each group, which partial aggregation merges, says between which two values a rank lies; then those below are
    counted, and only values between the two, each once with its count, are ranked. A group is nowhere sorted or held whole.
    """
    rows = df.filter(F.col(col).isNotNull()).select(*by, F.col(col).cast("double").alias("__v"))
    qs = [q for q, _ in wanted.values()]
    off = MARGIN / ACCURACY
    marks = F.percentile_approx("__v", [p for q in qs for p in (max(0.0, q - off), min(1.0, q + off))], ACCURACY)
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"), marks.alias("__marks"))

    def bracket(i: int, name: str, q: float, rule) -> Column:
        whole = F.col("n") <= SMALL
        at = rule(q, F.col("n"))
        low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("n") - 1))
        mark = lambda k, least: F.when(whole, F.col(least)).otherwise(F.get("__marks", F.lit(2 * i + k)))
        return F.struct(F.lit(name).alias("name"), low.alias("low"), (at - low).alias("part"), mark(0, "__lo").alias("lo"), mark(1, "__hi").alias("hi"))

    asked = sketch.select(*by, "n", F.inline(F.array(*[bracket(i, name, q, rule) for i, (name, (q, rule)) in enumerate(wanted.items())])))
    keys = [f"__k{i}" for i in range(len(by))]
    met = rows.toDF(*keys, "__v").join(asked, [F.col(k).eqNullSafe(F.col(b)) for k, b in zip(keys, by, strict=True)]) if by else rows.crossJoin(asked)
    group = [*by, "n", "name", "low", "part"]
    # values below the bracket are one row of the group, with no value
    counted = met.filter(F.col("__v") <= F.col("hi")).groupBy(*group, F.when(F.col("__v") >= F.col("lo"), F.col("__v")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*by, "name").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("c").over(w))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    picked = ranked.groupBy(*group).agg(at(F.col("low")).alias("a"), at(F.col("low") + 1).alias("b"))
    value = F.col("a") + F.coalesce(F.col("part") * (F.col("b") - F.col("a")), F.lit(0.0))
    return picked.withColumn("value", value).groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted])
