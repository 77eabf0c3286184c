"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..shared import stored


def _dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """df by ranges of the order, each row with its range (_part) and its number there (_nth, from 1); stored once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done + 1, done + n + 1))], [*b.schema.names, "_part", "_nth"])
            done += n

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, _part int, _nth long"))


def _before(window: WindowSpec) -> Column:
    return F.coalesce(F.sum("_n").over(window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df with the place of each row (from 1) in the given order, which should have no ties. The sizes of the ranges, one
    row each, give the offsets."""
    dealt = _dealt(df, *order)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", _before(Window.partitionBy(F.lit(0))).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def numbered_within(df: DataFrame, group: str, *order: Column | str, name: str = "rank") -> DataFrame:
    """The place of each row among those of its group, also where one group has a third of all rows: ranges are of group
    and order, and each range and group has one offset. Rows and offsets meet by both, so that a group that fills many
    ranges is in as many places. Null is a group too."""
    dealt = _dealt(df, F.col(group), *order)
    sizes = dealt.groupBy("_part", F.col(group).alias("_group")).agg(F.count("*").alias("_n"), F.min("_nth").alias("_first"))
    before = sizes.select(F.col("_part").alias("_range"), "_group", (_before(Window.partitionBy("_group")) - F.col("_first") + 1).alias("_offset"))
    met = dealt.join(before, (dealt["_part"] == before["_range"]) & dealt[group].eqNullSafe(before["_group"]))
    return met.withColumn(name, F.col("_nth") + F.col("_offset")).drop("_part", "_nth", "_range", "_group", "_offset")
