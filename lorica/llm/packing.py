"""Packing token ids into sequences by shortest-pack-first over the histogram of lengths.

Documents are tokenised once, cut at multiples of the sequence length, and only the lengths, ranks and checksums of
the pieces are kept. The histogram (at most as many bins as a sequence has places) goes to the driver, where patterns
of lengths are formed with counts. A piece finds its place from its rank among the pieces of its length; ranks come
from counts per partition, so that no length, however common, meets in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep, texts
from .tokens import Pieces, Units
from .words import pieces

LENGTH, END_ID = 2048, 1


def cut(docs: DataFrame, path: str, size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document (ids of its text, then end_id), stored: doc_id, start, length, ids_crc32,
    doc_tokens, part (partition that made it) and nth (its number among those of its length there, from 0)."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, seen = TaskContext.get().partitionId(), Pieces.known(path, ids=True), np.zeros(size + 1, np.int64)
        for b in pieces(batches, limit=1 << 20):  # beside what is remembered
            w = Units(b.column(1), known.lower)
            token, ids = known.of(w)
            flat = np.frombuffer(b"".join(ids), np.uint32)
            n = np.array([len(one) // 4 for one in ids], np.int64)
            lens = n[token] if len(n) else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(lens)])
            begin = (np.cumsum(n) - n)[token] if len(n) else lens
            all_ids = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, lens)]
            bounds, rows = ends[w.first], []
            for d, doc in enumerate(b.column(0).to_pylist()):
                own = np.append(all_ids[bounds[d] : bounds[d + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), size):
                    x = own[at : at + size]
                    rows.append((doc, at, len(x), zlib.crc32(x.tobytes()), len(own), part, int(seen[len(x)])))
                    seen[len(x)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
        known.forget()

    return keep(texts(docs).mapInArrow(pieces_of, ", ".join(f"{n} long" for n in names)))


def patterns(histogram: dict[int, int], size: int = LENGTH) -> list[tuple[int, list[int]]]:
    """(count, lengths) of the packs: lengths are placed longest first, each into the shortest pack there is, if it
    fits, else into a new one; a pattern stands for all packs of equal content."""
    packs: list[tuple[int, int, int, tuple]] = []  # used, tie, count, content as nested pairs
    tie = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= size:
                used, _, count, content = heapq.heappop(packs)
                n = min(count, left)
                if count > n:
                    heapq.heappush(packs, (used, (tie := tie + 1), count - n, content))
            else:
                used, n, content = 0, left, ()
            heapq.heappush(packs, (used + length, (tie := tie + 1), n, (length, content)))
            left -= n
    out = []
    for _, _, count, content in sorted(packs, key=lambda p: (-p[0], p[1])):
        lengths = []
        while content:
            length, content = content
            lengths.append(length)
        out.append((count, lengths[::-1]))
    return out


def places(packs: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): where pieces of a length from a rank on lie."""
    rows, ranks, sequence = [], {}, 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rows.append((length, ranks.get(length, 0), sequence, offset))
            ranks[length] = ranks.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, path: str, size: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Documents that repeat a doc_id are packed one by one. An empty table
    gives no rows.
    """
    made = cut(docs, path, size, end_id)
    counts = keep(made.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    sent = made.sparkSession.sparkContext.broadcast(places(patterns(histogram, size)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value
        most = int(place[:, 1].max(initial=0)) + 1
        key = place[:, 0] * most + place[:, 1]
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(b.schema.get_field_index(n)).to_numpy() for n in ("length", "rank"))
                row = np.searchsorted(key, length * most + np.minimum(rank, most - 1), "right") - 1
                spot = [pa.array(place[row, 2] + rank - place[row, 1]), pa.array(place[row, 3])]
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names[:5]] + spot, names)

    ranked = made.join(base, ["part", "length"]).select(*names[:5], (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(put, ", ".join(f"{n} long" for n in names))
