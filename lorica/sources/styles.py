"""Style sheets as rows: one for each selector and declaration, with the conditions under which it holds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROW = "ord int, selector string, prop string, value string, important boolean, media array<string>, min_width double, max_width double"
_ROW = [("ord", pa.int32()), ("selector", pa.string()), ("prop", pa.string()), ("value", pa.string()), ("important", pa.bool_()), ("media", pa.list_(pa.string())), ("min_width", pa.float64()), ("max_width", pa.float64())]

_TOKEN = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|\\.|[{};(),]|[^{};(),"'/\\]+|.""", re.S)
#: Width conditions of media queries, in pixels. Fixed formats.
_MOST = re.compile(r"(?:max-width\s*:|width\s*<=)\s*(\d+(?:\.\d+)?)px", re.I)
_LEAST = re.compile(r"(?:min-width\s*:|width\s*>=)\s*(\d+(?:\.\d+)?)px", re.I)


@dataclass
class Block:
    """An open brace: a rule with selectors, a media query with its condition, or another at-rule with neither."""

    selectors: list[str] | None = None
    media: str | None = None


def _selectors(prelude: str) -> list[str]:
    out, depth = [""], 0
    for token in _TOKEN.findall(prelude):
        depth += (token == "(") - (token == ")")
        if token == "," and depth == 0:
            out.append("")
        else:
            out[-1] += token
    return [s.strip() for s in out if s.strip()]


def _opened(prelude: str) -> Block:
    if not prelude.startswith("@"):
        return Block(selectors=_selectors(prelude))
    name, _, condition = re.match(r"@([\w-]*)(\s*)(.*)", prelude, re.S).groups()
    return Block(media=condition.strip()) if name.lower() == "media" else Block()


def declarations(css: str) -> Iterator[tuple]:
    """The rows of one sheet. Braces, semicolons and commas in comments, strings and parentheses are text. A selector is
    as it is written, also within other rules; what is still open at the end is closed there."""
    blocks: list[Block] = []
    text: list[str] = []
    depth = order = 0

    def declared() -> Iterator[tuple]:
        nonlocal order
        prop, colon, value = "".join(text).strip().partition(":")
        text.clear()
        if not colon or not blocks or not blocks[-1].selectors:
            return
        media = [b.media for b in blocks if b.media is not None]
        most, least = ([float(x) for m in media for x in width.findall(m)] for width in (_MOST, _LEAST))
        plain, important = re.subn(r"\s*!\s*important\s*\Z", "", value.strip(), flags=re.I)
        for selector in blocks[-1].selectors:
            yield (order, selector, prop.strip(), plain, bool(important), media, max(least, default=None), min(most, default=None))
        order += 1

    for token in _TOKEN.findall(css):
        if token.startswith("/*"):
            continue
        if token in "()":
            depth = max(0, depth + (1 if token == "(" else -1))
        if depth or token not in "{};":
            text.append(token)
        elif token == "{":
            blocks.append(_opened("".join(text).strip()))
            text.clear()
        else:
            yield from declared()
            if token == "}" and blocks:
                blocks.pop()
    yield from declared()


def _batch(named: list[tuple], key: pa.Field) -> pa.RecordBatch:
    columns = zip(*named, strict=True) if named else [[]] * (1 + len(_ROW))
    fields = [key, *(pa.field(*f) for f in _ROW)]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def parsed(sheets: DataFrame, key: str, css: str = "css") -> DataFrame:
    """(key, ord, selector, prop, value, important, media, min_width, max_width) of sheets (key, css), one after the
    other in their tasks. Null and empty sheets have no rows."""
    kind = sheets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if text:
                    yield _batch([(name.as_py(), *row) for row in declarations(text)], b.schema.field(0))

    return sheets.select(key, css).mapInArrow(run, f"`{key}` {kind}, {ROW}")


#: Bytes of sheets that one partition reads, one sheet at least.
PARTITION_BYTES = 4 << 20


class Sheets(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class StyleReader(DataSourceReader):
    """Lists the .css files below a folder by name, deals them to partitions of about so many bytes, and parses each
    where it is read."""

    def __init__(self, options: dict[str, str]):
        self.root, self.bytes = options["path"], int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))

    def _store(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.root if "://" in self.root or not self.root.startswith("file:") else "file://" + self.root.removeprefix("file:"))

    def partitions(self) -> list[Sheets]:
        store, at = self._store()
        found = sorted((f for f in store.get_file_info(pafs.FileSelector(at, recursive=True)) if f.is_file and f.extension == "css"), key=lambda f: f.path)
        dealt: list[list[str]] = []
        left = 0
        for f in found:
            if f.size > left or not dealt:
                dealt.append([])
                left = self.bytes
            dealt[-1].append(f.path[len(at.rstrip("/")) + 1 :])
            left -= f.size
        return [Sheets(names) for names in dealt]

    def read(self, partition: Sheets) -> Iterator[pa.RecordBatch]:
        store, at = self._store()
        for name in partition.paths if partition else []:
            with store.open_input_stream(f"{at.rstrip('/')}/{name}") as f:
                yield _batch([(name, *row) for row in declarations(f.read().decode("utf-8", "replace"))], pa.field("file", pa.string()))


class StyleSheets(DataSource):
    """``spark.read.format("stylesheets").load(folder)``: file (below the folder) and the columns of ROW. The folder is
    read with the file systems of Arrow (local, HDFS, S3, GCS); for other stores read texts with Spark and use parsed()."""

    @classmethod
    def name(cls) -> str:
        return "stylesheets"

    def schema(self) -> str:
        return f"file string, {ROW}"

    def reader(self, schema: StructType) -> StyleReader:
        return StyleReader(dict(self.options))


def stylesheets(spark: SparkSession, folder: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    spark.dataSource.register(StyleSheets)
    return spark.read.format("stylesheets").option("partitionBytes", partition_bytes).load(folder)
