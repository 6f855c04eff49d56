"""Tables that change by whole versions: a reader never sees half of a change.

A store is a folder. The data of a change lie in a folder of their own, and `manifests/<number>.json` names the folders that make up
each table; it is written last, by a rename that fails if the number is taken. What a job wrote before that, nobody sees. Rows of a
table with a key lie in parts by the key's hash, and an upsert rewrites only the parts that its rows fall in. A change may carry
the number of a stream's batch: one that is in already is not made again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a table with a key, unless the caller has another number; about one for each GB.
PARTS = 16


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under `spark.checkpoint.dir`, which driver and executors share; in local mode without it, a temporary one."""
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-evspark-")
    return f"{root.rstrip('/')}/evspark-{name}-{uuid.uuid4().hex[:12]}"


@dataclass
class Change:
    """What becomes of a table. `rows` replace all, or with `key` those of equal keys (`upsert`), or are added (`append`)."""

    rows: DataFrame
    mode: str = "overwrite"
    key: str | None = None
    parts: int = PARTS


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self.hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, below: str):
        return self.hadoop.Path(f"{self.path}/{below}")

    def _names(self, below: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self._path(below))] if self.fs.exists(self._path(below)) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """The last one, or that of a version; an empty one if there is none."""
        if version is None:
            found = self.versions()
            if not found:
                return {"version": 0, "tables": {}, "meta": {}, "batches": {}}
            version = found[-1]
        stream = self.fs.open(self._path(f"manifests/{version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def has_batch(self, stream: str, batch: int) -> bool:
        return self.manifest()["batches"].get(stream, -1) >= batch

    def commit(self, manifest: dict) -> None:
        """Make a manifest the last one. Fails if another job was first."""
        name = f"manifests/{manifest['version']}.json"
        temp = self._path(f"manifests/.{uuid.uuid4().hex}")
        out = self.fs.create(temp, False)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        none = self.spark._sc._gateway.new_array(self.hadoop.Options.Rename, 1)
        none[0] = self.hadoop.Options.Rename.NONE
        self.hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, self._path(name), none)

    def table(self, name: str, version: int | None = None, only: set[str] | None = None) -> DataFrame | None:
        """A table as of the last version or another; with `only`, of these parts. None if there is no such table."""
        own = self.manifest(version)["tables"].get(name)
        if own is None:
            return None
        schema = StructType.fromJson(own["schema"])
        folders = sorted({f for part, found in own["folders"].items() if only is None or part in only for f in found})
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def change(self, changes: dict[str, Change], meta: dict | None = None, stream: str | None = None, batch: int = 0) -> dict:
        """Make all changes, or none; gives the manifest that holds. A batch of a stream that is in already changes nothing."""
        old = self.manifest()
        if stream is not None and self.has_batch(stream, batch):
            return old
        home = f"data/{old['version'] + 1}-{uuid.uuid4().hex[:12]}"
        tables = old["tables"] | {name: self._written(name, c, old["tables"].get(name), f"{home}/{name}") for name, c in changes.items()}
        batches = old["batches"] | ({stream: batch} if stream is not None else {})
        new = {"version": old["version"] + 1, "written_at": datetime.now(UTC).isoformat(timespec="seconds"), "tables": tables, "meta": old["meta"] | (meta or {}), "batches": batches}
        self.commit(new)
        return new

    def _written(self, name: str, change: Change, old: dict | None, folder: str) -> dict:
        if change.mode == "append":
            if old is not None:
                self._same(name, change.rows, old)
            change.rows.write.parquet(f"{self.path}/{folder}")
            return {"schema": change.rows.schema.jsonValue(), "key": None, "parts": 1, "folders": {"all": [*(old["folders"]["all"] if old else []), folder]}}
        if change.key is None:
            change.rows.write.parquet(f"{self.path}/{folder}")
            return {"schema": change.rows.schema.jsonValue(), "key": None, "parts": 1, "folders": {"all": [folder]}}
        parts = old["parts"] if old and change.mode == "upsert" else change.parts
        staged = f"{folder}-new"
        self._by_part(change.rows, change.key, parts, staged, once=True)
        touched = {n.split("=")[1] for n in self._names(staged) if n.startswith("part=")}
        if old is None or change.mode == "overwrite":
            return {"schema": change.rows.schema.jsonValue(), "key": change.key, "parts": parts, "folders": {p: [f"{staged}/part={p}"] for p in sorted(touched)}}
        self._same(name, change.rows, old)
        if not touched:
            return old
        # what is new stays as it was written; of the old rows of these parts, those that it does not replace are written beside it
        new = self.spark.read.schema(change.rows.schema).parquet(*[f"{self.path}/{staged}/part={p}" for p in sorted(touched)])
        self._by_part(self.table(name, only=touched).join(new.select(change.key), change.key, "left_anti").select(*new.columns), change.key, parts, folder)
        stayed = {n.split("=")[1] for n in self._names(folder) if n.startswith("part=")}
        return old | {"folders": old["folders"] | {p: [*([f"{folder}/part={p}"] if p in stayed else []), f"{staged}/part={p}"] for p in sorted(touched)}}

    def _same(self, name: str, rows: DataFrame, old: dict) -> None:
        kinds = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
        if kinds(rows.schema) != kinds(StructType.fromJson(old["schema"])):
            raise ValueError(f"rows for {name} have other columns than the table")

    def _by_part(self, rows: DataFrame, key: str, parts: int, folder: str, once: bool = False) -> None:
        """Write rows by parts, with `once` one of each key. A part is written in slices, by other bits of the key's hash, so that more tasks than parts share the work; the rows of a key are in one slice, so one shuffle serves for both."""
        at = F.xxhash64(key)
        slices = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // parts)
        part: Column = F.pmod(at, F.lit(parts))
        dealt = rows.withColumns({"part": part, "__slice": F.pmod(F.shiftright(at, 32), F.lit(slices))}).repartition("part", "__slice")
        kept = dealt.dropDuplicates(["part", "__slice", key]) if once else dealt
        kept.drop("__slice").write.partitionBy("part").parquet(f"{self.path}/{folder}")

    def vacuum(self, keep: int = 2) -> None:
        """Remove all versions but the last `keep`, and data that none of these names. No job may write meanwhile."""
        kept = self.versions()[-keep:]
        named = {f.split("/")[1] for v in kept for t in self.manifest(v)["tables"].values() for found in t["folders"].values() for f in found}
        for v in self.versions()[:-keep]:
            self.fs.delete(self._path(f"manifests/{v}.json"), True)
        for n in self._names("data"):
            if n not in named:
                self.fs.delete(self._path(f"data/{n}"), True)
