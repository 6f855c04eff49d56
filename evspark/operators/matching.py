"""Which of many strings stand in which texts, without comparing every text with every string."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Characters of the patterns that a pass over the texts carries to every task; more patterns take more passes.
PATTERN_CHARS = 1 << 20
#: Length of the grams by which texts and patterns meet.
GRAM = 3


def find_patterns(texts: DataFrame, patterns: DataFrame, text_col: str, pattern_col: str, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep` of a text and `pattern`, once for each text and pattern that stands in it. For long texts and curated lists.

    One automaton of all patterns runs over each text once. Patterns come as they are; null and empty ones stand nowhere.
    """
    wanted = patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern != ''").distinct()
    total = wanted.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    passes = max(1, -(-total // PATTERN_CHARS))
    source = texts.select(F.col(text_col).alias("__text"), *keep)
    out = StructType([*source.schema.fields[1:], StructField("pattern", StringType())])
    found = None
    for i in range(passes):
        words = [r.pattern for r in wanted.filter(F.pmod(F.xxhash64("pattern"), F.lit(passes)) == i).collect()]

        def run(batches: Iterator[pa.RecordBatch], words=words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for n, word in enumerate(words):
                machine.add_word(word, n)
            if words:
                machine.make_automaton()
            for batch in batches:
                rows, which = [], []
                for at, text in enumerate(batch.column(0).to_pylist()):
                    here = sorted({n for _, n in machine.iter(text)}) if words and text else []
                    rows += [at] * len(here)
                    which += [words[n] for n in here]
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(c.take(taken) for c in batch.columns[1:]), pa.array(which, pa.string())], out.names)

        part = source.mapInArrow(run, out)
        found = part if found is None else found.unionByName(part)
    return found


def grams(text: Column) -> Column:
    """All different substrings of 1 to GRAM characters."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(k) for k in range(1, GRAM + 1)]))


def _long_grams(text: Column) -> Column:
    n = F.length(text)
    return F.when(n >= GRAM, F.array_distinct(F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: F.substring(text, i, F.lit(GRAM)))))


def first_containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, first: for each different pattern (column `pattern`) the least `rank` of the texts (text, rank) that contain it; patterns that stand nowhere have no row. For short texts, however many there are of both.

    Texts and patterns meet by equal grams. A pattern of up to GRAM characters is a gram, whose least rank is known without a look at
    texts; a longer one meets the texts that have its rarest gram. Null and empty patterns have no row.
    """
    wanted = patterns.filter("pattern != ''").select("pattern").distinct()
    each = texts.filter("text IS NOT NULL").groupBy("text").agg(F.min("rank").alias("rank"))
    of_text = each.select("rank", "text", F.explode(grams(F.col("text"))).alias("gram"))
    known = of_text.groupBy("gram").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"))
    short = wanted.filter(F.length("pattern") <= GRAM).join(known.select(F.col("gram").alias("pattern"), "first"), "pattern")
    options = wanted.filter(F.length("pattern") > GRAM).select("pattern", F.explode(_long_grams(F.col("pattern"))).alias("gram"))
    rarest = options.join(known.select("gram", "n"), "gram", "left").groupBy("pattern").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    met = rarest.filter("n > 0").select("pattern", "gram").join(of_text.filter(F.length("gram") == GRAM), "gram").filter(F.col("text").contains(F.col("pattern")))
    return short.select("pattern", "first").unionByName(met.groupBy("pattern").agg(F.min("rank").alias("first")))


def first_contained(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text, first: for each different text (column `text`) the least `rank` of the patterns (pattern, rank) that stand in it. For short texts, however many there are of both; by grams, as `first_containing`."""
    each = texts.filter("text IS NOT NULL").select("text").distinct()
    wanted = patterns.filter("pattern != ''").groupBy("pattern").agg(F.min("rank").alias("rank"))
    of_text = each.select("text", F.explode(grams(F.col("text"))).alias("gram"))
    counts = of_text.filter(F.length("gram") == GRAM).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    options = wanted.filter(F.length("pattern") > GRAM).select("pattern", "rank", F.explode(_long_grams(F.col("pattern"))).alias("gram"))
    rarest = options.join(counts, "gram", "left").groupBy("pattern", "rank").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    anchored = rarest.unionByName(wanted.filter(F.length("pattern") <= GRAM).select("pattern", "rank", F.col("pattern").alias("gram")))
    met = of_text.join(anchored, "gram").filter(F.col("text").contains(F.col("pattern")))
    return met.groupBy("text").agg(F.min("rank").alias("first"))
