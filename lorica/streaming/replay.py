"""Tables as streams, and sinks that may get a batch twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame, root: str, run: str, name: str = "run") -> None:
    """Writes df as the partition ``run`` of the table at root. What an earlier try has written under that name is
    replaced, all other partitions stay, so that a run that is repeated after a failure counts once."""
    df.withColumn(name, F.lit(run)).write.partitionBy(name).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)


def once(root: str, name: str = "run") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: each batch is the partition of its number, however often it is delivered."""

    def sink(batch: DataFrame, number: int) -> None:
        written(batch, root, f"{number:010d}", name)

    return sink


def drained(stream: DataFrame, root: str, mode: str, name: str = "run") -> DataFrame:
    """Runs a stream over all that is there and returns what it has put out, with the number of its batch."""
    spark = stream.sparkSession
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(once(f"{root}/out", name)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, `{name}` string").parquet(f"{root}/out")


def replayed(events: DataFrame, root: str, at: str = "ts", slices: int = 3) -> DataFrame:
    """events as a stream of files, earlier ones first: cut into so many slices of equal time, each written after the one
    before. A batch takes as many files as the slice of most files has, so that there are no more batches than slices,
    however many files these have; it may reach into the next slice, but leaves none of an earlier one behind. A watermark
    that allows as much delay as a slice lasts (see lateness()) drops nothing."""
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    part = F.lit(0) if lo is None else F.least(F.lit(slices - 1), F.floor((F.unix_micros(at) - F.unix_micros(F.lit(lo))) * slices / F.greatest(F.lit(1), F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)))))
    spark, files = events.sparkSession, [0]
    for k in range(slices):
        events.where(F.coalesce(part, F.lit(0)) == k).write.mode("append").parquet(root)
        files.append(len(spark.read.schema(events.schema).parquet(root).inputFiles()))
    most = max(z - a for a, z in zip(files, files[1:], strict=False))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", max(1, most)).parquet(root)


def shares(events: DataFrame, rows: int = 50_000) -> int:
    """Shares of keys for the state of a stream over all events: each of about so many rows."""
    return max(64, -(-events.count() // rows))


def lateness(events: DataFrame, at: str = "ts", slices: int = 3) -> str:
    """The delay that replayed() may bring about."""
    lo, hi = events.agg(F.min(at), F.max(at)).first()
    return "0 seconds" if lo is None else f"{int((hi - lo).total_seconds() / slices) + 1} seconds"


def closed(spark: SparkSession, schema, root: str, row: tuple) -> None:
    """Appends a row from far ahead to a replayed table: the watermark passes all others."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(root)
