"""Tables on disk that change: ledgers, rollouts, upserts of touched buckets, releases that replace each other at once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import stored
from ..streaming.replay import written


class Folder:
    """A folder of any store that Hadoop knows, with renames that never replace what is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway, self.spark, self.path = spark._jvm, spark.sparkContext._gateway, spark, path.rstrip("/")
        self.at = self._at("")
        conf = spark._jsc.hadoopConfiguration()
        self.files = self.at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.makeQualified(self.at).toUri(), conf)

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.files.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self._at(name))) if self.exists(name) else []

    def moved(self, old: str, new: str) -> bool:
        """Renames; False if the new name is taken."""
        to = self.files.makeQualified(self._at(new))
        self.files.mkdirs(to.getParent())
        none = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.context.rename(self.files.makeQualified(self._at(old)), to, none)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self._at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str:
        return bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(self.files.open(self._at(name)))).decode()

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)


# ledgers and rollouts


def runs(spark: SparkSession, root: str, name: str = "run") -> list[str]:
    """The names of the runs in a ledger, in order."""
    return [n.removeprefix(f"{name}=") for n in Folder(spark, root).names() if n.startswith(f"{name}=")]


def append_run(rows: DataFrame, root: str, run: str, most: int = 100) -> None:
    """Appends a run to a ledger of which the last ``most`` runs are kept. Runs are in the order of their names. A run that
    is repeated, after a failure or because it was delivered twice, is there once."""
    written(rows, root, run)
    folder = Folder(rows.sparkSession, root)
    for old in runs(rows.sparkSession, root)[:-most]:
        folder.delete(f"run={old}")


def complete_next(wanted: DataFrame, root: str, run: str, key: str, order: Sequence[str], cap: int = 1) -> DataFrame:
    """One step of a rollout: the first ``cap`` rows of wanted, by order and key, that no other run has completed, are
    written as this run's and returned. A run that is repeated completes the same rows again. With nothing left it writes
    nothing."""
    spark = wanted.sparkSession
    others = [r for r in runs(spark, root) if r != run]
    left = wanted
    if others:
        done = spark.read.parquet(*(f"{root}/run={r}" for r in others)).select(key)
        left = wanted.join(done, key, "left_anti")
    chosen = stored(left.orderBy(*order, key).limit(cap))
    if not chosen.isEmpty():
        written(chosen, root, run)
    return chosen


# upserts


def upsert(rows: DataFrame, root: str, key: str, buckets: int = 64) -> list[int]:
    """Rows of a table at root, dealt to buckets by their key, are replaced by those of the same key; new keys are added.
    Only buckets in which a row is new or differs are written, all others keep their files. Returns the written buckets.
    The number of buckets is the table's for good: choose it so that a bucket fits a task. A key that comes twice is an
    error; null is a key. A second run after a failure writes what the first one would have."""
    spark, names = rows.sparkSession, rows.columns
    new = stored(rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    twice = new.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} {twice[0][0]} comes twice")
    if not Folder(spark, root).exists():
        new.repartition("bucket").write.partitionBy("bucket").parquet(root)
        return sorted(r[0] for r in new.select("bucket").distinct().collect())
    touched = [r[0] for r in new.select("bucket").distinct().collect()]
    old = spark.read.schema(new.schema).parquet(root).where(F.col("bucket").isin(touched))
    x, y = old.select("bucket", F.col(key).alias("k"), F.struct(*names).alias("old")), new.select("bucket", F.col(key).alias("k"), F.struct(*names).alias("new"))
    both = x.join(y, (x["bucket"] == y["bucket"]) & x["k"].eqNullSafe(y["k"]), "full_outer").select(F.coalesce(x["bucket"], y["bucket"]).alias("bucket"), "old", "new")
    both = stored(both)
    changed = sorted(r[0] for r in both.where(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).select("bucket").distinct().collect())
    if changed:
        out = both.where(F.col("bucket").isin(changed)).select(F.coalesce("new", "old").alias("r"), "bucket").select("r.*", "bucket")
        out.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(root)
    return changed


# releases


def _next(folder: Folder) -> int:
    return max((int(n) for n in folder.names("pointers")), default=0) + 1


def _point(folder: Folder, release: str) -> None:
    """Names a release as the current one: the pointer with the highest number counts, and a number can be had once, so
    of publishers at the same time each has its own. No clock is asked."""
    draft = f"staging/{uuid.uuid4().hex}"
    folder.write(draft, release)
    number = _next(folder)
    while not folder.moved(draft, f"pointers/{number:012d}"):
        number = max(number + 1, _next(folder))


def publish(df: DataFrame, root: str, release: str) -> None:
    """Writes a release aside, gives it its name in one step, then names it as the current one. A write that fails, or a
    name that is taken, leaves everything as it was but for files in staging; the releases before are kept."""
    folder, draft = Folder(df.sparkSession, root), f"staging/{uuid.uuid4().hex}"
    if folder.exists(f"releases/release={release}"):
        raise ValueError(f"release {release} is there already")
    df.write.parquet(f"{folder.path}/{draft}")
    if not folder.moved(draft, f"releases/release={release}"):
        raise ValueError(f"release {release} is there already")
    _point(folder, release)


def rollback(spark: SparkSession, root: str, release: str) -> None:
    folder = Folder(spark, root)
    if not folder.exists(f"releases/release={release}"):
        raise ValueError(f"there is no release {release}")
    _point(folder, release)


def current_name(spark: SparkSession, root: str) -> str:
    folder = Folder(spark, root)
    return folder.read(f"pointers/{folder.names('pointers')[-1]}")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the release that was named last."""
    return spark.read.parquet(f"{root.rstrip('/')}/releases/release={current_name(spark, root)}")


def retained(spark: SparkSession, root: str) -> DataFrame:
    """All releases, each row with the release that it belongs to."""
    return spark.read.parquet(f"{root.rstrip('/')}/releases")
