"""Tables that cut lineage, in the folder that the driver and the executors share."""

from __future__ import annotations

import secrets
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a folder of this machine serves a session that
    runs on this machine alone; on a cluster the setting is needed."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lorica-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


_LOCAL: dict[str, str] = {}
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def keep(df: DataFrame, page_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back. page_rows: rows of a Parquet page at most. Parquet
    looks at the size of a page after 100 rows only; of rows of a MB that makes pages of up to 100 MB, and an executor
    holds on to buffers of that size outside its heap."""
    spark = df.sparkSession
    path = scratch(spark)
    write = df.write if page_rows is None else df.write.options(**{"parquet.page.row.count.limit": page_rows, "parquet.page.size.row.check.min": page_rows})
    write.parquet(path)
    if _STAGE:
        _STAGE[-1].append(path)
    table_ = spark.read.schema(df.schema).parquet(path)
    _PATHS[table_] = path
    return table_


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes kept tables; nothing that reads them may run any more."""
    for t in tables:
        delete(t.sparkSession, _PATHS.pop(t))


_STAGE: list[list[str]] = []


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was kept within it but the table kept last: a stage's result."""
    _STAGE.append([])
    try:
        yield
    finally:
        paths = _STAGE.pop()
        for path in paths[:-1]:
            delete(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS: dict[str, int] = {}


def word_key(spark: SparkSession) -> int:
    """The number under which words are hashed: drawn anew for each application, so that no text can be made to collide.
    ``spark.lorica.wordKey`` sets it where tables of hashes are to outlive the application."""
    return int(spark.conf.get("spark.lorica.wordKey", None) or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.randbits(63)))


#: Bytes of an Arrow batch that goes to Python. Spark's own bound is of 10,000 rows, tens of MB of text, which a task
#: holds in the JVM and in Python at the same time.
BATCH_BYTES = 4 << 20


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns of any name cannot clash; null texts become empty."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def fold(column: str | Column, buckets: int, folds: tuple[int, ...]) -> Column:
    """crc32 of the id as text, modulo ``buckets``, is among ``folds``."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.crc32(c.cast("string").cast("binary")) % buckets).isin(*folds)
