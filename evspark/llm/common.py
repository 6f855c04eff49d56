"""What the operators share: tables in the cluster's shared folder, and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Characters that end a word, `[\x20\x09-\x0D]`.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch between Spark and Python, where the session has Spark's default of 10,000: a batch holds whole texts.
BATCH_ROWS = 1000
#: Texts that a Python worker has as Python objects at a time.
PASSED = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-evspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders that this driver has named, in order.
FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    FOLDERS.append(f"{shared_dir(spark)}/evspark-{name}-{uuid.uuid4().hex[:12]}")
    return FOLDERS[-1]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that no later job reads."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write `df` to the shared folder and read it again: cuts the lineage, and survives the loss of an executor. Also gives the folder."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def written(df: DataFrame, name: str) -> DataFrame:
    return written_at(df, name)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def null_safe(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)])


def ordinals(rows: DataFrame, repeated: DataFrame, keys: list[str], name: str) -> DataFrame:
    """`rows` with `name`: the number, from 1, of a row among those that have equal `keys`, in any order.

    `repeated`: the keys that several rows have, each once; a table, empty as a rule.
    """
    if repeated.isEmpty():
        return rows.withColumn(name, F.lit(1))
    again = [f"__again{i}" for i in range(len(keys))]
    keyed, on = repeated.select(*keys).toDF(*again), null_safe(keys, again)
    numbered = rows.join(keyed, on, "left_semi").withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1))))
    return rows.join(keyed, on, "left_anti").withColumn(name, F.lit(1)).unionByName(numbered)


def lookup(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of `rows` with `groups`, which has each key once and in `size` its number of rows.

    Keys that hold a thousandth of `total` rows or more (so at most a thousand keys) are broadcast; the rows of the others are
    shuffled by key. Any key may be hot without a task getting all its rows. `rows` is read twice, so it should be a table.
    """
    least = max(100, total // 1000)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = groups.filter(F.col(size) < least)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS rows from now on, unless the session has a number of its own: a batch of long texts is held by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = PASSED) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def per_text(docs: DataFrame, id_col: str, text_col: str, made: pa.Schema, work: Callable[[list[str]], list], extra: tuple[str, ...] = (), rows: int = PASSED) -> DataFrame:
    """One row per row of `docs`: the id and the columns `extra` as they are, and the columns `made`, which `work` makes of a list of texts (a null text counts as empty).

    Ids stay in Arrow, so that null, repeated and large ones come back unchanged. Rows keep their partition.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *extra)
    own = kept.columns[1:]
    fields = [StructField(f"own{i}", f.dataType) for i, f in enumerate(kept.schema.fields[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows):
            columns = work([t or "" for t in part.column(0).to_pylist()])
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, made, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *arrays], [*[f"own{i}" for i in range(len(own))], *made.names])

    out = kept.toDF("text", *[f.name for f in fields]).mapInArrow(run, StructType([*fields, *from_arrow_schema(made).fields]))
    return out.toDF(id_col, *own[1:], *made.names)
