"""Files as tables: Markdown with a head, JSON, settings, rules, binaries."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a configuration file that the driver reads at most.
SMALL = 1 << 20


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, draft, body) of the .md files below a folder. A file without head or title is an error."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.md$", 1)
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    body = F.regexp_extract("value", r"(?s)\A---\r?\n.*?\r?\n---(?:\r?\n)?(.*)\z", 1)
    title = F.regexp_extract(head, r"""(?m)^title:\s*["']?(.+?)["']?\s*$""", 1)
    checked = F.when(title != "", title).otherwise(F.raise_error(F.concat(F.lit("no title: "), name)))
    return raw.select(name.alias("id"), checked.alias("title"), F.regexp_extract(head, r"(?m)^draft:\s*(true)\s*$", 1).eqNullSafe("true").alias("draft"), body.alias("body"))


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def inside(root: str, relative: str) -> str:
    """A path below root, or an error."""
    parts: list[str] = []
    for p in relative.split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"{relative} leads out of {root}")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    if relative.startswith("/") or not parts:
        raise ValueError(f"{relative} is not below {root}")
    return f"{root.rstrip('/')}/{'/'.join(parts)}"


def pointed(spark: SparkSession, root: str, pointer: str, field: str, schema: str) -> DataFrame:
    """The JSON document that a small pointer file names."""
    target = spark.read.option("multiLine", True).json(f"{root}/{pointer}").select(field).first()[0]
    return json_documents(spark, inside(root, target), schema)


def settings(lines: DataFrame) -> DataFrame:
    """(name, value) of NAME=value lines (value: string): export, comments and quotes are understood, the last wins."""
    row = lines.select(F.trim("value").alias("v"), "ord").where("v <> '' and not startswith(v, '#')")
    parts = lambda i: F.regexp_extract("v", r"^(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*)$", i)
    raw = F.trim(parts(2))
    quoted: Column = F.regexp_extract(raw, r"""^(["'])(.*)\1$""", 2)
    value = F.when(raw.rlike(r"""^(["']).*\1$"""), quoted).otherwise(F.trim(F.regexp_replace(raw, r"\s+#.*$", "")))
    name = F.when(parts(1) != "", parts(1)).otherwise(F.raise_error(F.lit("a line is not NAME=value")))
    return row.select(name.alias("name"), value.alias("value"), "ord").groupBy("name").agg(F.max_by("value", "ord").alias("value"))


def small_text(spark: SparkSession, path: str) -> DataFrame:
    """(value) of one small configuration file. Spark's readers pass over names that begin with _ or a dot; such a file
    is read by the driver, up to SMALL bytes; a larger one is an error."""
    if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
        return spark.read.text(path, wholetext=True)
    store, at = pafs.FileSystem.from_uri(path)
    if store.get_file_info(at).size > SMALL:
        raise ValueError(f"{path} is larger than {SMALL} bytes")
    with store.open_input_stream(at) as f:
        return spark.createDataFrame([(f.read().decode(),)], "value string")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """(ord, from, to, status) of redirect lines; a missing status is 302."""
    lines = small_text(spark, path).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    f = F.split(F.trim("line"), r"\s+")
    return lines.where("trim(line) <> '' and not startswith(trim(line), '#')").select("ord", f[0].alias("from"), f[1].alias("to"), F.coalesce(F.try_element_at(f, F.lit(3)).cast("int"), F.lit(302)).alias("status"))


def binaries(spark: SparkSession, folder: str, pattern: str = "*.mp3") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def narrated(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of a folder that are no drafts, by the name of their file."""
    return markdown(spark, folder).where("not draft").orderBy("id")


def recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256, seconds) of the MP3 files below a folder; each is read once, in its task."""
    from ..functions.python_udfs import mp3_seconds

    return binaries(spark, folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), mp3_seconds(F.col("content")).alias("seconds"))


def pictures(spark: SparkSession, folder: str, pattern: str = "*.{png,webp}") -> DataFrame:
    """(path, file, bytes, kind, width, height) of the pictures below a folder, from the beginnings of the files."""
    from ..functions.pictures import picture_size

    size = binaries(spark, folder, pattern).select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), picture_size(F.col("content")).alias("s"))
    return size.select("path", "file", "bytes", "s.kind", "s.width", "s.height")
