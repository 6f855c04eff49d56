"""Mixing sources to target weights.

The words of each source are packed into blocks of fixed length. Every output shard draws how many of its slots each source fills;
a source's slots, counted over the shards, go through pseudorandom permutations of the source's block numbers, one for each pass; and
slots and blocks are joined by number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import WORD, null_safe, ordinals, slices, small_batches, written
from evspark.llm.textscan import mix

#: Words of a block; slots of an output shard.
BLOCK, SHARD = 64, 4096
#: The weights of sources by code point, repeating; a source is used so many times at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Rows whose texts are held at a time.
PASSED = 256
#: Rows of a part, about: a source's documents, and its shards, are numbered by parts side by side.
ROWS_A_PART = 4096
#: Sources whose names and sizes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 100_000
SEED = 20240607


def targets(sizes: np.ndarray, weights: np.ndarray, most: int = MOST) -> np.ndarray:
    """Shares of the sum of sizes by weight; those above `most` times their size stop there, and the rest is shared again until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, capped = np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while not capped.all():
        left = max(0.0, sizes.sum() - most * sizes[capped].sum())
        out = np.where(capped, most * sizes, left * weights / weights[~capped].sum())
        above = ~capped & (out > most * sizes)
        if not above.any():
            break
        capped |= above
    return np.where(capped, most * sizes, out)


def draw(shard: int, slots: int, share: np.ndarray) -> np.ndarray:
    """How many of a shard's slots each source fills: the whole parts of its expected numbers, and a multinomial draw of what is left over by the fractions.

    A multinomial draw of all slots has the same expectation; with the whole parts fixed, a source is off its target by less than a
    slot a shard, where the plain draw is off by the root of the slots.
    """
    expected = slots * share
    counts = np.floor(expected + 1e-9).astype(np.int64)
    rest = slots - int(counts.sum())
    if rest > 0:
        fraction = np.maximum(expected - counts, 0)
        fraction = fraction / fraction.sum() if fraction.sum() > 0 else share
        counts += np.random.default_rng((SEED, shard)).multinomial(rest, fraction)
    return counts


def permuted(i: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 puts i: four Feistel rounds over the next power of four, walked on until below n."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    low, out = np.uint64((1 << half) - 1), i.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


@dataclass
class Mixture:
    """documents: id, source, size, digest (of the text), s (source number), start (of its words in the source). sources: source, source_size, s, weight, target, blocks, slots (one row a source, in pandas).
    slots: shard, s, pass, block. pieces: s, block, start, from_word (in the document), words."""

    documents: DataFrame
    sources: pd.DataFrame
    slots: DataFrame
    pieces: DataFrame

    def times(self) -> DataFrame:
        """s, block, times. It grows with the corpus though it begins with a small range of shards, from which Spark takes its size: hence the hint."""
        return self.slots.groupBy("s", "block").agg(F.count(F.lit(1)).alias("times")).hint("merge")

    def taken(self) -> DataFrame:
        """s, start, taken: words that the mix takes of each document that it takes any of."""
        return self.pieces.join(self.times(), ["s", "block"]).groupBy("s", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_col)).alias("digest")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def _before(rows: DataFrame, size: str, order: list[str], name: str) -> DataFrame:
    """`rows` (with s and part) with `name`: the sum of `size` over the source's earlier parts and over the earlier rows of the part."""
    running = lambda *by: Window.partitionBy(*by[0]).orderBy(*by[1]).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("s", "part").agg(F.sum(size).alias("__n"))
    parts = parts.select("s", "part", F.coalesce(F.sum("__n").over(running(["s"], ["part"])), F.lit(0)).alias("__base"))
    within = rows.withColumn("__within", F.coalesce(F.sum(size).over(running(["s", "part"], order)), F.lit(0)))
    return within.join(parts, ["s", "part"]).withColumn(name, F.col("__base") + F.col("__within")).drop("__base", "__within", "part")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS) -> Mixture:
    """Plan the mix of `docs`. Sources with a null name are one source, the last. What comes to the driver is a row for each source."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sized = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), _digest(text_col)), "sizes")
    # a row for each source; UTF-8 order is that of code points
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).orderBy(F.col("source").isNull(), "source").toPandas()
    sources["s"] = np.arange(len(sources))
    sources["weight"] = [weights[i % len(weights)] for i in range(len(sources))]
    n = sources["source_size"].to_numpy(np.int64)
    sources["target"] = targets(n, sources["weight"].to_numpy())
    blocks = -(-n // BLOCK)
    wanted = np.where(n > 0, sources["target"] / np.maximum(n, 1) * blocks, 0.0)
    sources["blocks"], sources["slots"] = blocks, wanted
    share, total = wanted / max(wanted.sum(), 1e-9), int(round(wanted.sum()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                counts = draw(shard, min(SHARD, total - shard * SHARD), share)
                s = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shard, np.int64)), pa.array(s.astype(np.int32)), pa.array(counts[s])], ["shard", "s", "n"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, source, j = (batch.column(i).to_numpy() for i in range(3))
            turn = j // np.maximum(blocks[source], 1)
            block = np.zeros(len(j), np.int64)
            kept = turn < MOST  # a draw may go a little beyond what a source can give
            for s, e in np.unique(np.stack([source[kept], turn[kept]], axis=1), axis=0).tolist():
                at = (source == s) & (turn == e)
                block[at] = permuted(j[at] % blocks[s], int(blocks[s]), (SEED + s) * 31 + e)
            yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (shard, source, turn.astype(np.int32), block)], ["shard", "s", "pass", "block"])

    shards = spark.range(-(-total // SHARD)) if total else spark.range(0)
    counts = shards.mapInArrow(place, "shard long, s int, n long").withColumn("part", F.expr(f"shard div {ROWS_A_PART}"))
    first = _before(counts, "n", ["shard"], "first").select("shard", "s", "first", "n")
    # dealt out by shard, so that a task makes the slots of some shards and not all of a source
    numbered = first.repartition("shard").select("shard", "s", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("j"))
    slots = numbered.mapInArrow(number, "shard long, s int, pass int, block long")

    names = spark.createDataFrame([(x, i) for i, x in enumerate(sources["source"])], "__source string, s int")
    rows = sized.join(_few(names, len(sources)), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    n_parts = -(-int(sources["rows"].sum()) // ROWS_A_PART) or 1
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "digest"), F.lit(n_parts)))
    placed = _before(rows, "size", ["id", "size", "digest"], "start")
    documents = written(placed.select("id", "source", "size", "digest", "s", "start"), "placed")
    end = F.col("start") + F.col("size")
    cut = documents.filter("size > 0").select("s", "start", "size", F.explode(F.sequence(F.expr(f"start div {BLOCK}"), F.expr(f"(start + size - 1) div {BLOCK}"))).alias("block"))
    lo, hi = F.greatest("start", F.col("block") * BLOCK), F.least(end, (F.col("block") + 1) * BLOCK)
    pieces = cut.select("s", "block", "start", (lo - F.col("start")).alias("from_word"), (hi - lo).alias("words"))
    return Mixture(documents, sources, slots, pieces)


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target (of its source), taken (words of it that the mix takes, repeats counted).

    A null or empty text has size 0 and is never taken; a null source is a source. Rows that repeat an id are documents of their own.
    No document is taken more than three times over. Reruns agree.
    """
    plan = mixture(docs, id_col, text_col, source_col)
    facts = docs.sparkSession.createDataFrame(plan.sources[["s", "source_size", "target"]].astype({"s": "int32"}), "s int, source_size long, target double")
    # (s, start) names a document with words; one without has none taken
    taken = plan.taken().hint("merge")
    full, empty = plan.documents.filter("size > 0"), plan.documents.filter("size = 0")
    rows = full.join(taken, ["s", "start"], "left").unionByName(empty.withColumn("taken", F.lit(0).cast("long")))
    return rows.join(_few(facts, len(plan.sources)), "s").select(F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with the text that the mix takes of each: its pieces in their order, neighbours together; a second and third pass over it on lines of their own.

    Documents of which nothing is taken are not in the mix. Rows that repeat an id, or lack one, are documents of their own: a row has
    the cuts of its id, source and text, and of rows that are equal in these each has the cuts of one. Other columns pass through.
    """
    plan = mixture(docs, id_col, text_col, source_col)
    cut = plan.pieces.join(plan.times(), ["s", "block"]).groupBy("s", "start").agg(F.sort_array(F.collect_list(F.struct("from_word", "words", "times"))).alias("__cut"))  # as many as the document has blocks
    keys, own = ["id", "source", "digest"], ["__id", "__source", "__digest"]
    full = plan.documents.filter("size > 0")
    again = written(full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toDF(*own, "n"), "equal-rows")
    full = ordinals(full.withColumnsRenamed(dict(zip(keys, own, strict=True))), again, own, "__nth")
    by_key = full.join(cut.hint("merge"), ["s", "start"]).select(*own, "__nth", "__cut").withColumnsRenamed({k: f"{k}_cut" for k in [*own, "__nth"]})
    keyed = ordinals(docs.select("*", F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), _digest(text_col).alias("__digest")), again, own, "__nth")
    rows = keyed.join(by_key.hint("merge"), null_safe([*own, "__nth"], [f"{k}_cut" for k in [*own, "__nth"]]))

    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, PASSED):
            texts = [_taken_text(t, cuts) for t, cuts in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
            arrays = [pa.array(texts, part.schema.field(at).type) if i == at else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    small_batches(docs.sparkSession)
    return rows.select(*docs.columns, "__cut").mapInArrow(run, docs.schema)


def _taken_text(text: str, cuts: list[dict[str, int]]) -> str:
    places = [m.span() for m in re.finditer(WORD, text)]
    lines = []
    for k in range(MOST):
        runs: list[list[int]] = []
        for x in cuts:
            if x["times"] > k:
                lo, hi = x["from_word"], x["from_word"] + x["words"]
                if runs and runs[-1][1] == lo:
                    runs[-1][1] = hi
                else:
                    runs.append([lo, hi])
        if runs:
            lines.append(" ".join(text[places[lo][0] : places[hi - 1][1]] for lo, hi in runs))
    return "\n".join(lines)
