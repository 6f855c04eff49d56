"""Exact duplicates by two passes over a Bloom filter.

The first pass counts, for every row, the slots of its hash and keeps the slots that are hit twice or more as bitmaps. The second
pass tests each row against them: a row with a slot that only it hits has no equal, and passes straight through; only the others
are shuffled by their hash. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import ascii_lower, lookup, null_safe, ordinals, written

#: Bits of the filter for each row. The filter stops growing at MAX_BITS (64 MB): with more rows than it is made for, more of them
#: are shuffled than need be, and the result is the same.
BITS_A_ROW, MAX_BITS = 16, 1 << 29
_BUCKET = 32768  # bits of a bitmap of bitmap_construct_agg


def _slots(digest: str, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(digest), F.lit(i)), F.lit(bits)) + 1 for i in range(1, hashes + 1)]


def repeated_slots(rows: DataFrame, digest: str, bits: int, hashes: int = 2) -> DataFrame:
    """Bitmaps (bucket, bitmap) of the slots that two or more hashes hit: bits / 32768 rows of 4 KB at most."""
    hits = rows.select(F.explode(F.array(*_slots(digest, bits, hashes))).alias("slot")).groupBy("slot").count().filter("count > 1")
    return hits.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def filter_bits(rows: int, bits_a_row: int) -> int:
    return min(MAX_BITS, 1 << max(15, (bits_a_row * rows - 1).bit_length()))


def possibly_repeated(rows: DataFrame, digest: str, bits: int, hashes: int = 2) -> DataFrame:
    """`rows` with a column `maybe`: false only if no other row has the same `digest`."""
    bitmaps, out, columns = repeated_slots(rows, digest, bits, hashes), rows, rows.columns
    for i, slot in enumerate(_slots(digest, bits, hashes)):
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{i}"), F.col("bitmap").alias(f"bitmap{i}")))  # MAX_BITS / 8 bytes at most
        at = F.pmod(slot - 1, F.lit(_BUCKET))
        byte = F.conv(F.hex(F.substring(f"bitmap{i}", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        hit = F.getbit(byte.cast("long"), F.pmod(at, F.lit(8)).cast("int")) == 1
        out = out.join(side, F.bitmap_bucket_number(slot) == F.col(f"bucket{i}"), "left").withColumn(f"hit{i}", F.coalesce(hit, F.lit(False)))
    return out.select(*columns, reduce(Column.__and__, [F.col(f"hit{i}") for i in range(hashes)]).alias("maybe"))


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_a_row: int = BITS_A_ROW) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the largest id
    stays; a null id counts as smaller than any other, and rows that repeat the largest id stay together. Other columns are not
    looked at. An empty table gives an empty result.
    """
    rows = written(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(ascii_lower(F.coalesce(text_col, F.lit(""))).cast("binary"), 256)).alias("digest")), "digests")
    total = rows.count()
    tested = possibly_repeated(rows, "digest", filter_bits(total, bits_a_row))
    maybe = written(tested.filter("maybe").drop("maybe"), "maybe-repeated")
    groups = maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max("id").alias("keep_id"))
    alone = tested.filter("not maybe").select("digest", "id", F.lit(1).cast("long").alias("group_size"), F.col("id").alias("keep_id"))
    found = lookup(maybe, groups, "digest", "group_size", total).select(*alone.columns)
    return alone.unionByName(found).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each group, of rows that repeat the largest id any one."""
    groups = written(duplicate_groups(docs, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias("__key"), F.col("text_sha256").alias("__sha"), "kept"), "groups")
    gone = groups.filter("not kept").distinct().toDF("__gone", "__gone_sha", "kept")
    again = written(groups.filter("kept").groupBy("__key", "__sha").count().filter("count > 1"), "kept-again")
    rows = docs.withColumn("__key", F.col(id_col)).withColumn("__sha", F.sha2(ascii_lower(F.coalesce(text_col, F.lit(""))).cast("binary"), 256))
    keys = ["__key", "__sha"]
    return ordinals(rows.join(gone, null_safe(keys, ["__gone", "__gone_sha"]), "left_anti"), again, keys, "__nth").filter("__nth = 1").select(*docs.columns)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.text_sha256 = g.text_sha256
"""
