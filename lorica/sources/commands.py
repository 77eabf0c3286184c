"""What other programs print, as rows."""

from __future__ import annotations

import subprocess
import tempfile
import threading
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a program's output in one batch, and characters of its complaint that an error repeats.
LINES, SAID = 1000, 500


def _run(argv: list[str], batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Feeds column 0 to a program, a line for each row, while its lines are read. A program that ends badly is an error."""
    with tempfile.TemporaryFile() as complaint:  # of this task alone
        p = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=complaint, text=True, encoding="utf-8")
        failed: list[BaseException] = []

        def feed() -> None:
            try:
                for b in batches:
                    p.stdin.writelines(f"{line}\n" for line in b.column(0).to_pylist())
                p.stdin.close()
            except BrokenPipeError:  # it has read enough; how it ends says whether that is right
                pass
            except BaseException as e:
                failed.append(e)
                p.kill()

        thread = threading.Thread(target=feed, daemon=True)
        thread.start()
        try:
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array([p.stdout.read()], pa.string())], ["value"])
            else:
                held: list[str] = []
                for line in p.stdout:
                    held.append(line)
                    if len(held) == LINES:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
            code = p.wait()
            thread.join()
        finally:
            p.kill()
            p.wait()
        if failed:
            raise failed[0]
        if code:
            complaint.seek(0)
            raise RuntimeError(f"{argv[0]} ended with {code}: {complaint.read().decode(errors='replace')[-SAID:]}")


def _rows(values: DataFrame, schema: str, array: bool) -> DataFrame:
    """Values as JSON of the schema; what is none is an error."""
    said = values.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    kind, strict = f"array<struct<{schema}>>" if array else f"struct<{schema}>", {"mode": "FAILFAST"}
    parsed = F.from_json("value", kind, strict)
    return said.select(F.inline(parsed)) if array else said.select(parsed.alias("r")).select("r.*")


def command(spark: SparkSession, argv: Sequence[str], schema: str, array: bool = False) -> DataFrame:
    """The output of a program that runs in one task: a JSON object on each line, or one array in all. schema: as in
    'a: int, b: string'. It runs again whenever the rows are computed anew."""
    args = list(argv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield from _run(args, iter(()), array)

    values = spark.range(0, 1, 1, 1).mapInArrow(run, "value string")
    return _rows(values, schema, array)


def piped(df: DataFrame, argv: Sequence[str], schema: str) -> DataFrame:
    """df through a program: each partition starts its own, which gets the rows as lines of JSON and prints its own. The
    program must be there on every executor; it may print more or fewer lines than it reads."""
    args = list(argv)
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    return _rows(lines.mapInArrow(lambda b: _run(args, b, False), "value string"), schema, False)
