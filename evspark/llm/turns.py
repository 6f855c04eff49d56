"""Turns of conversations in their order, where one conversation may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from evspark.llm.common import null_safe, small_batches, slices, written


def in_order(rows: DataFrame, group: str, order: list[Column], size: Column, name: str) -> DataFrame:
    """A table of `rows` with `at`, the number from 0 of a row in its group by `order`, and `start`, the sum of `size` over the rows before it.

    Rows are dealt out by ranges of group and order, so that a large group lies in many partitions; each partition numbers its own
    rows in one pass, and what a group has in earlier partitions is added from a table of at most two rows for each partition. Rows
    that `order` does not tell apart have any order. A null group is a group. Rows of an empty table give an empty table.
    """
    small_batches(rows.sparkSession)
    keys = [F.asc_nulls_first(group), *order]
    own = rows.withColumns({"__size": size.cast("long"), "__row": F.monotonically_increasing_id()})
    dealt = own.repartitionByRange(*keys, "__row").sortWithinPartitions(*keys).drop("__row").withColumn("__part", F.spark_partition_id())
    at_group = dealt.columns.index(group)
    at_size = dealt.columns.index("__size")
    fields = [*dealt.schema.fields, StructField("at", LongType()), StructField("start", LongType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at, start = pa.nulls(1), 0, 0
        for batch in slices(batches):
            column, numbers, starts = batch.column(at_group), [], []
            before = pa.concat_arrays([last.cast(column.type), column.slice(0, batch.num_rows - 1)])
            same = pc.or_(pc.equal(column, before).fill_null(False), pc.and_(column.is_null(), before.is_null())).to_pylist()
            for goes_on, more in zip(same, batch.column(at_size).to_pylist(), strict=True):
                if not goes_on:
                    at, start = 0, 0
                numbers.append(at)
                starts.append(start)
                at, start = at + 1, start + more
            last = column.slice(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64()), pa.array(starts, pa.int64())], [f.name for f in fields])

    numbered = written(dealt.mapInArrow(number, StructType(fields)), name)
    pieces = numbered.groupBy("__part", F.col(group).alias("__group")).agg(F.max(F.col("at") + 1).alias("__n"), F.max(F.col("start") + F.col("__size")).alias("__sum"))
    whole = Window.partitionBy("__group")
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.withColumns({"__at": F.sum("__n").over(before), "__start": F.sum("__sum").over(before), "__first": F.min("__part").over(whole)})
    carried = carried.filter(F.col("__part") > F.col("__first")).select(F.col("__part").alias("__of"), "__group", "__at", "__start")
    out = numbered.join(F.broadcast(carried), null_safe(["__part", group], ["__of", "__group"]), "left")
    out = out.withColumns({"at": F.col("at") + F.coalesce("__at", F.lit(0)), "start": F.col("start") + F.coalesce("__start", F.lit(0))})
    return out.select(*rows.columns, "at", "start")


def by_conversation(rows: DataFrame, order: list[str], work: Callable[[Iterator[tuple[bool, dict]]], Iterator[tuple]], out: StructType, group: str = "conv_id") -> DataFrame:
    """Send the rows of each group, by `order`, through `work` as (is the first of its group, row), and make rows of the tuples that it gives.

    A group is in one task, which holds a slice of it at a time.
    """
    small_batches(rows.sparkSession)
    schema = arrow_schema(out)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
        last = object()
        for batch in slices(batches):
            for row in batch.to_pylist():
                yield row[group] != last, row
                last = row[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, chars = [], 0
        for made in work(told(batches)):
            waiting.append(made)
            chars += sum(len(x) for x in made if isinstance(x, str))
            if len(waiting) >= 1000 or chars >= 1 << 22:
                yield batch_of(waiting, schema)
                waiting, chars = [], 0
        if waiting:
            yield batch_of(waiting, schema)

    dealt = rows.repartition(group).sortWithinPartitions(F.asc_nulls_first(group), *order)
    return dealt.mapInArrow(run, out)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(fields: StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in fields])
