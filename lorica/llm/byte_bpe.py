"""Byte-level BPE ids of whole texts, and texts from ids.

The vocabulary is a file of ranks (base64 of a token's bytes, its rank). The tokenizers library works on characters, so
each byte gets a printable character: its own, if that is printable, else one from 256 on. Merges follow from the ranks:
any two tokens whose bytes together are a token may merge, the lowest rank first; a pre-token that is a token stays whole.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import texts
from .words import pieces


def byte_characters() -> list[str]:
    """The character of each byte. Bytes without a printable character of their own (white space, controls, the soft
    hyphen) get those from 256 on, in order."""
    own = {*range(33, 127), *range(161, 256)} - {173}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """A tokenizer made from ranks, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, chars = read_ranks(path), byte_characters()
        written = lambda token: "".join(map(chars.__getitem__, token))
        by_rank = sorted(ranks, key=ranks.__getitem__)
        merges = [(written(t[:i]), written(t[i:])) for t in by_rank for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.tokenizer = Tokenizer(models.BPE(vocab={written(t): ranks[t] for t in by_rank}, merges=merges, ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        byte_of = {c: b for b, c in enumerate(chars)}
        tokens = {i: bytes(map(byte_of.__getitem__, t)) for t, i in self.tokenizer.get_vocab().items()}
        held = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.known = np.array([t is not None for t in held])
        self.size = np.array([len(t or b"") for t in held], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(t or b"" for t in held), np.uint8)

    def encode(self, some: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids, one after the other; the number of bytes of each)."""
        if len(ids) and (int(ids.max()) >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        size = self.size[ids]
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - size), size)
        return self.bytes[take], size


codec = functools.lru_cache(maxsize=4)(Codec)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """sizes[i] bytes of data for row i."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all ids of a column of binary ids, the number of each row)."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u4") if raw.ctypes.data % 4 == 0 else raw.copy().view("<u4"), np.diff(offsets) // 4


def sent(spark: SparkSession, path: str) -> str:
    """Sends the vocabulary to all executors; its name there, for opened()."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def opened(name: str, pattern: str) -> Codec:
    return codec(SparkFiles.get(name), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit numbers).

    Null texts count as empty and have no ids. Every row is encoded for itself, whatever its length: repeated and missing
    doc_ids keep a row each, equal rows have equal ids. An empty table gives none; other columns are not looked at.
    """
    name, names = sent(docs.sparkSession, path), ["doc_id", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(name, pattern)
        for b in pieces(batches, limit=1 << 20):
            ids = known.encode(b.column(1).to_pylist())
            sizes = np.array([len(i) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), _binary(np.concatenate(ids).astype("<u4").view(np.uint8), 4 * sizes)], names)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Of rows (doc_id, ids) the bytes: doc_id, n_tokens, ids, decoded (binary). Ids may begin or end within a character:
    bytes are put together first and are not looked at as characters, so that nothing is lost where a character is split
    between ids or rows. Null ids are none; an id that the vocabulary lacks is an error."""
    name, names = sent(encoded.sparkSession, path), ["doc_id", "n_tokens", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(name, pattern)
        for b in batches:
            if not b.num_rows:
                continue
            ids, counts = _ids(b.column(1))
            data, size = known.decode(ids)
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), b.column(1), _binary(data, np.diff(ends))], names)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def offsets(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, begin and end of each id in the decoded text, in code points, end exclusive. An id that holds part of a
    character spans the whole of it, so ids that share a character overlap there. Texts must be whole: bytes that are no
    UTF-8 have no code points."""
    name, names = sent(encoded.sparkSession, path), ["doc_id", "begin", "end"]
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = opened(name, pattern)
        for b in batches:
            begin, end = [], []
            for raw in b.column(1).to_pylist():
                data, size = known.decode(np.frombuffer(raw, "<u4"))
                first = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point that each byte belongs to
                stop = np.cumsum(size)
                begin.append(first[stop - size].astype(np.int32) if len(size) else np.zeros(0, np.int32))
                end.append((first[stop - 1] + 1).astype(np.int32) if len(size) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(begin, kind), pa.array(end, kind)], names)

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, begin array<int>, end array<int>")
