"""WARC files and their fixity, audited by Merkle trees.

Pages are written as WARC records, each a gzip member, in files of ascending page ids. The stored bytes of each record are hashed;
its place is hashed with it, and runs of neighbouring records, which are ranges of offsets, are hashed in order into the nodes of a
tree, up to a root for each file and one for the replica. Each replica's tree is made of what its own folder holds: files, their
lengths, and the records of the index in them. Replicas are compared by their roots, and only below nodes that differ are the trees
gone through, down to the damaged records.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.arrow_sequences import local_path
from evspark.llm.common import slices, small_batches, written

#: Children of a node; bytes after which a file ends with the record.
FANOUT, FILE_BYTES = 32, 1 << 26
#: Repeated page ids that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Bytes that are read at a time; characters of a file name's hash that make the nodes over the files.
PART, CROWN = 1 << 20, (4, 2, 0)
RECORDS = "file string, seq long, offset long, length long, digest binary"


def record(page_id: object, url: str, html: str, date: str, repeat: str | None = None) -> bytes:
    """A resource record. Line ends in the url are percent-encoded, so that a url stays one header; `repeat` tells apart records of one page id."""
    body, uri = html.encode(), url.replace("\r", "%0D").replace("\n", "%0A")
    own = f"urn:page:{page_id}" + (f":{repeat}" if repeat else "")
    head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <{own}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {uri}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def read_record(stored: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a stored record."""
    head, _, rest = zlib.decompress(stored, 31).partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def write(pages: DataFrame, folder: str, partitions: int, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the WARC files; gives file, seq, offset, length, digest (of the stored bytes), the page's id and record_length and record_sha256 (of the plain record).

    Null urls and pages count as empty; rows without an id come first and are named None; rows that share an id, or have none, have
    besides it a hash of url and page, and their number among equal rows, in the record's id. An empty table gives no file.
    """
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["file", "seq", "offset", "length", "digest", "page", "record_length", "record_sha256"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), None, pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        out: BinaryIO | None = None
        name, temp, seq, offset = "", "", 0, 0
        for batch in slices(batches):
            rows = []
            for page_id, url, html, repeat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out and offset >= FILE_BYTES:
                    out.close()
                    os.replace(temp, f"{path}/{name}")
                    out, count = None, count + 1
                if not out:
                    name = f"part-{part:06d}-{count:04d}.warc.gz"
                    temp, seq, offset = f"{path}/.{name}-{uuid.uuid4().hex}", 0, 0
                    out = open(temp, "wb")  # noqa: SIM115
                raw = record(page_id, url or "", html or "", date, repeat)
                stored = _member(raw)
                out.write(stored)
                rows.append((name, seq, offset, len(stored), hashlib.sha256(stored).digest(), None, len(raw), hashlib.sha256(raw).hexdigest()))
                seq, offset = seq + 1, offset + len(stored)
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0) if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
        if out:
            out.close()
            os.replace(temp, f"{path}/{name}")

    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("among", F.xxhash64("url", "html"))
    again = written(rows.groupBy("page").count().filter("count > 1").select(F.col("page").alias("again")), "repeated-pages")
    once, repeat = rows.withColumn("repeat", F.lit(None).cast("string")), Window.partitionBy("page", "among").orderBy("url", "html")
    if n := again.count():
        own, on = F.broadcast(again) if n <= BROADCAST_ROWS else again, F.col("page").eqNullSafe(F.col("again"))
        several = rows.join(own, on, "left_semi").withColumn("repeat", F.concat_ws("-", F.lower(F.hex("among")), F.row_number().over(repeat)))
        once = once.join(own, on, "left_anti").unionByName(several)
    order = [F.asc_nulls_first("page"), F.asc("repeat")]  # a second attempt of a task writes the same files
    dealt = once.select("page", "url", "html", "repeat").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    made = dealt.mapInArrow(run, f"file string, seq long, offset long, length long, digest binary, page {kind}, record_length long, record_sha256 string")
    return written(made.withColumnRenamed("page", id_col), "warc-records")


def places(index: DataFrame, folder: str) -> DataFrame:
    """file, seq, offset, length: what a replica's folder holds. The records of `index` in files that are there; after them, as one more, the bytes that a file has beyond; and as one record a file that `index` does not name. An empty file counts as not there."""
    spark = index.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), F.col("length").alias("size"))
    ends = index.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("n"))
    known = index.select("file", "seq", "offset", "length").join(files.select("file"), "file", "left_semi")
    end = F.coalesce("end", F.lit(0))
    beyond = files.join(ends, "file", "left").filter((F.col("size") > end) | F.col("end").isNull())
    return known.unionByName(beyond.select("file", F.coalesce("n", F.lit(0)).alias("seq"), end.alias("offset"), (F.col("size") - end).alias("length")))


def read_digests(places: DataFrame, folder: str) -> DataFrame:
    """Hash the stored bytes of a replica: file, seq, offset, length, digest. The digest is of the place, of how many bytes were there, and of these; of a record beyond a file's end, that is none."""
    path = local_path(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None
        for batch in batches:
            digests = []
            for file, offset, length in zip(*(batch.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                if file != name:
                    if own:
                        own.close()
                    name, own = file, open(f"{path}/{file}", "rb")  # noqa: SIM115
                own.seek(offset)
                stored, left = hashlib.sha256(), length
                while left and (part := own.read(min(left, PART))):
                    stored.update(part)
                    left -= len(part)
                digests.append(hashlib.sha256(struct.pack("<QQ", offset, length - left) + stored.digest()).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], ["file", "seq", "offset", "length", "digest"])
        if own:
            own.close()

    return places.select("file", "seq", "offset", "length").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def copy_replica(index: DataFrame, source: str, folder: str, damage: str | None = None) -> DataFrame:
    """Copy the files to `folder`; gives the names of the files. `damage` is a SQL condition on `index`: of records for which it holds, the copy's middle byte is inverted, as a failing disk might."""
    src, dst = local_path(source), local_path(folder)
    os.makedirs(dst, exist_ok=True)
    bad = index.filter(damage or "false").select("file", (F.col("offset") + F.expr("length div 2")).alias("at"))
    files = index.select("file").distinct().join(bad.groupBy("file").agg(F.collect_list("at").alias("at")), "file", "left")  # as many as the file has records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                temp = f"{dst}/.{name}-{uuid.uuid4().hex}"
                with open(f"{src}/{name}", "rb") as a, open(temp, "wb+") as b:
                    while part := a.read(1 << 20):
                        b.write(part)
                    for x in at or []:
                        b.seek(x)
                        byte = b.read(1)
                        b.seek(x)
                        b.write(bytes([byte[0] ^ 0xFF]))
                os.replace(temp, f"{dst}/{name}")
            yield batch.select(["file"])

    return written(files.mapInArrow(run, "file string"), "replica")


def tree(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the files' trees: file, seq, digest. The first has the records, the last a root a file."""
    levels = [records.select("file", "seq", "digest")]
    most = records.agg(F.max("seq")).first()[0] or 0
    while most:
        children = F.sort_array(F.collect_list(F.struct("seq", "digest")))  # fanout at most
        joined = F.concat(F.array_join(F.transform(children, lambda x: F.hex(x["digest"])), ""))
        node = levels[-1].groupBy("file", F.expr(f"seq div {fanout}").alias("seq")).agg(F.unhex(F.sha2(F.unhex(joined), 256)).alias("digest"))
        levels.append(written(node, "tree"))
        most //= fanout
    return levels


def crown(roots: DataFrame) -> list[DataFrame]:
    """The levels of the tree over a replica's files: key, digest. Files stand by a hash of their names, so that a node's place needs no count of files; the last level is the replica's one root."""
    levels = [roots.select(F.sha2("file", 256).alias("key"), F.struct("file", "digest").alias("of"))]
    levels[0] = levels[0].select("key", F.unhex(F.sha2(F.concat(F.encode("of.file", "utf-8"), F.lit(b"\0"), F.col("of.digest")), 256)).alias("digest"))
    for width in CROWN:
        children = F.sort_array(F.collect_list(F.struct("key", "digest")))
        joined = F.concat(F.array_join(F.transform(children, lambda x: F.concat(x["key"], F.hex(x["digest"]))), ""))
        levels.append(written(levels[-1].groupBy(F.substring("key", 1, width).alias("key")).agg(F.unhex(F.sha2(joined.cast("binary"), 256)).alias("digest")), "crown"))
    return levels


def _unequal(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of nodes that differ, or that one side lacks."""
    both = x.withColumnRenamed("digest", "x").join(y.withColumnRenamed("digest", "y"), keys, "full_outer")
    return written(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select(*keys), "differing")


def differing_files(a: DataFrame, b: DataFrame) -> DataFrame:
    """file: by their roots (file, digest), the files that differ or that only one replica has. The roots of the replicas come first, and of what is below only what differs is looked at."""
    found, width = None, 0
    for (x, y), narrow in zip(reversed(list(zip(crown(a), crown(b), strict=True))), (*reversed(CROWN), 64), strict=True):
        if found is not None:
            above = found.select(F.col("key").alias("above"))
            x, y = (level.join(above, F.substring("key", 1, width) == F.col("above"), "left_semi") for level in (x, y))
        found, width = _unequal(x, y, ["key"]), narrow
    names = a.select("file").union(b.select("file")).distinct()
    return names.join(found, F.sha2("file", 256) == F.col("key"), "left_semi")


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """file, seq of the records that differ, or that only one replica has. Trees of different heights are compared from the lower one's top."""
    files = written(differing_files(*(levels[min(len(a), len(b)) - 1].groupBy("file").agg(_joined_roots()) for levels in (a, b))), "differing")
    found = None
    for x, y in reversed(list(zip(a, b, strict=False))):
        x, y = (level.join(files, "file", "left_semi") for level in (x, y))
        if found is not None:
            below = found.select("file", F.col("seq").alias("node"))
            x, y = (level.withColumn("node", F.expr(f"seq div {fanout}")).join(below, ["file", "node"], "left_semi").drop("node") for level in (x, y))
        found = _unequal(x, y, ["file", "seq"])
    return found


def _joined_roots() -> Column:
    """One digest of a file's top nodes: a single one, but where the other replica's trees are lower."""
    tops = F.sort_array(F.collect_list(F.struct("seq", "digest")))
    return F.unhex(F.sha2(F.array_join(F.transform(tops, lambda x: F.hex(x["digest"])), "").cast("binary"), 256)).alias("digest")


def compare(index: DataFrame, primary: str, replica: str) -> DataFrame:
    """file, seq, offset, what: each place at which the replicas differ. 'changed', 'missing' or 'extra' (in the replica): a record of `index`, the bytes of a file after its last record, or a file that `index` does not name."""
    a, b = (written(read_digests(places(index, x), x), "digests") for x in (primary, replica))
    bad = differing(tree(a), tree(b))
    of = lambda df, name: df.select("file", "seq", F.col("offset").alias(name))
    both = bad.join(of(a, "here"), ["file", "seq"], "left").join(of(b, "there"), ["file", "seq"], "left")
    what = F.when(F.col("there").isNull(), "missing").when(F.col("here").isNull(), "extra").otherwise("changed")
    return both.select("file", "seq", F.coalesce("here", "there").alias("offset"), what.alias("what"))


def audit(index: DataFrame, primary: str, replica: str) -> DataFrame:
    """`index` with `intact`: whether both replicas hold the same bytes of the record at its place. What the replicas have beside the index is in `compare`."""
    bad = compare(index, primary, replica).select("file", "seq", F.lit(True).alias("__bad"))
    return index.join(bad, ["file", "seq"], "left").withColumn("intact", F.col("__bad").isNull()).drop("__bad")


SQL = r"""
WITH r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM pages)
SELECT page_id, strlen(record) AS record_length, sha256(record) AS record_sha256, NOT (substr(md5(page_id::VARCHAR), 1, 2) < '04') AS intact FROM r
"""
