"""Benchmark decontamination through a stored positional inverted index.

The index is dealt by documents: each segment holds the postings of some whole documents (up to SEGMENT_WORDS words,
one document at least). Words are coded by 64-bit hashes under the application's key; all positions of a segment lie on one axis with a gap
between documents, so that an offset never leads from one document into another. A search reads each segment once,
starts each phrase from the term with the shortest list in that segment and intersects with the other terms' lists,
shifted by their offsets. No document text and no posting moves between tasks; only the phrases are broadcast, in
blocks of a checked size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, texts, word_key
from .words import ALNUM, Words, lists, pieces

WINDOW = 10
#: Words in a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 18
#: Phrases of one broadcast block, at most; further phrases take further passes over the index.
BLOCK_PHRASES = 200_000
#: Postings looked at together within a task.
LIST_WORDS = 1 << 20

INDEX_SCHEMA = "rows array<long>, doc_ids array<long>, starts array<int>, lengths array<int>, terms array<long>, ends array<int>, positions array<int>"
_INDEX = pa.schema([("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])


def build_index(docs: DataFrame, gap: int = WINDOW) -> DataFrame:
    """Segments of a positional index over whole texts, as a stored table. Null texts have no words, yet a row."""
    key = word_key(docs.sparkSession)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        total, done = 0, TaskContext.get().partitionId() << 40

        def flush(done: int) -> pa.RecordBatch:
            ids = [x for i, _, _ in held for x in i]
            lengths = np.concatenate([c for _, c, _ in held])
            h = np.concatenate([x for _, _, x in held]).view(np.int64)
            starts = np.cumsum(lengths + gap) - lengths - gap
            at = np.arange(len(h)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
            order = np.argsort(h, kind="stable")
            terms, first = np.unique(h[order], return_index=True)
            one = lambda x, kind: lists(x, np.array([len(x)]), kind)
            cols = [one(done + np.arange(len(ids)), pa.int64()), pa.array([ids], pa.list_(pa.int64())), one(starts.astype(np.int32), pa.int32()), one(lengths.astype(np.int32), pa.int32()), one(terms, pa.int64()), one(np.append(first[1:], len(h))[: len(terms)].astype(np.int32), pa.int32()), one(at[order].astype(np.int32), pa.int32())]
            return pa.RecordBatch.from_arrays(cols, schema=_INDEX)

        for b in pieces(batches, limit=1 << 20):
            w = Words(b.column(1), ALNUM, lower=True, key=key)
            held.append((b.column(0).to_pylist(), w.counts(), w.hash))
            total += len(w.hash)
            if total >= SEGMENT_WORDS:
                yield flush(done)
                held, total, done = [], 0, done + sum(len(i) for i, _, _ in held)
        if held:
            yield flush(done)

    return keep(texts(docs).mapInArrow(index, INDEX_SCHEMA), page_rows=1)  # a row is a segment


class Segment:
    """The postings of one row of the index."""

    def __init__(self, row: pa.StructScalar | dict):
        self.doc_ids, self.rows = row["doc_ids"], row["rows"]
        self.starts, self.lengths, self.ends, self.positions = (np.asarray(row[k], np.int64) for k in ("starts", "lengths", "ends", "positions"))
        self.terms = np.asarray(row["terms"], np.int64)
        self.begins = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        size = int(self.starts[-1] + self.lengths[-1]) if len(self.starts) else 0
        self.at = np.full(size + 1, -1, np.int64)  # the term at each position: the lists, turned round
        self.at[self.positions] = np.repeat(np.arange(len(self.terms)), self.ends - self.begins)

    def codes(self, terms: np.ndarray) -> np.ndarray:
        """The place of each term in this segment's dictionary, -1 if absent."""
        if not len(self.terms):
            return np.full(terms.shape, -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def list_of(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all the coded terms, and for each the index into code."""
        n = self.ends[code] - self.begins[code]
        total = np.cumsum(n)
        which = np.repeat(np.arange(len(code)), n)
        return self.positions[np.arange(total[-1] if len(total) else 0) - np.repeat(total - n, n) + self.begins[code][which]], which

    def phrases(self, terms: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of each exact occurrence. terms: one row per phrase, filled up on the right."""
        used = np.arange(terms.shape[1]) < lengths[:, None]
        codes = self.codes(terms)
        df = np.where(codes >= 0, (self.ends - self.begins)[codes] if len(self.ends) else 0, 0)
        alive = np.flatnonzero((df > 0).sum(1) == lengths)
        alive = alive[lengths[alive] > 0]
        if not len(alive):
            return alive, alive
        codes, df, used = codes[alive], np.where(used[alive], df[alive], np.iinfo(np.int64).max), used[alive]
        by_rarity = np.argsort(df, axis=1, kind="stable")
        cost = np.cumsum(df[np.arange(len(alive)), by_rarity[:, 0]])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        lo = 0
        while lo < len(alive):  # bounded memory: so many phrases at once as their shortest lists allow
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + LIST_WORDS, "right")))
            found.append(self._intersect(codes[lo:hi], used[lo:hi], by_rarity[lo:hi], alive[lo:hi]))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _intersect(self, codes: np.ndarray, used: np.ndarray, by_rarity: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rarest = by_rarity[:, 0]
        at, which = self.list_of(codes[np.arange(len(codes)), rarest])
        at = at - rarest[which]
        for k in range(1, codes.shape[1]):
            off = by_rarity[which, k]
            to = at + off
            ok = ~used[which, off] | ((at >= 0) & (to < len(self.at)) & (self.at[np.clip(to, 0, len(self.at) - 1)] == codes[which, off]))
            at, which = at[ok], which[ok]
        ok = at >= 0
        return names[which[ok]], at[ok]

    def near(self, terms: np.ndarray, distance: int) -> list[int]:
        """Documents in which all the terms lie within ``distance`` words, for one set of terms."""
        codes = self.codes(np.unique(terms))
        if (codes < 0).any():
            return []
        codes = codes[np.argsort((self.ends - self.begins)[codes], kind="stable")]
        lists_ = [self.positions[self.begins[c] : self.ends[c]] for c in codes]
        # a narrowest window starts at one of the terms; the rarest term leaves few of them
        left = np.concatenate(lists_)
        doc = np.searchsorted(self.starts, left, "right") - 1
        right = np.minimum(left + distance, self.starts[doc] + self.lengths[doc] - 1)
        for x in lists_:
            i = np.searchsorted(x, left)
            ok = (i < len(x)) & (x[np.minimum(i, len(x) - 1)] <= right)
            left, right, doc = left[ok], right[ok], doc[ok]
        return [self.doc_ids[d] for d in np.unique(doc)]


def phrase_table(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms) for each distinct window of each item; an item of fewer words is one window. Null texts have
    none. Rows that repeat an item_id, or have none, are one item."""
    schema, key = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.int64()))]), word_key(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column(1), ALNUM, lower=True, key=key)
            h, ids = w.hash.view(np.int64), b.column(0).to_pylist()
            rows = [(ids[d], h[i : min(i + window, hi)].tolist()) for d, (lo, hi) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)) if hi > lo for i in range(lo, max(hi - window, lo) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], schema=schema)

    source = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(cut, "item_id long, terms array<long>").distinct()


def blocks(phrases: DataFrame, limit: int = BLOCK_PHRASES) -> list[DataFrame]:
    """The phrases as one block if they are few, else in as many as keep each below the limit."""
    phrases = keep(phrases)
    n = -(-phrases.count() // limit)
    return [phrases] if n <= 1 else [phrases.where(F.pmod(F.xxhash64("terms", "item_id"), F.lit(2 * n)) == k) for k in range(2 * n)]


def search(index: DataFrame, parts: list[DataFrame], window: int = WINDOW) -> DataFrame:
    """One row per document and block of phrases (see blocks()): row (its number in the index), doc_id, n_words, hits
    (positions of hit words), items (ids of the items with an occurring phrase), both without repeats. Without phrases:
    no hits."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.int64()))])
    spark = index.sparkSession
    out = None
    for block in parts:
        rows = block.toArrow()
        lengths = np.array([len(x) for x in rows["terms"].to_pylist()], np.int64)
        terms = np.zeros((len(lengths), window), np.int64)
        for i, x in enumerate(rows["terms"].to_pylist()):
            terms[i, : len(x)] = x
        named = rows["item_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        sent = spark.sparkContext.broadcast((named.indices.to_numpy().astype(np.int64), named.dictionary, terms, lengths))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, ids, terms, lengths = sent.value
            for batch in batches:
                for k in range(batch.num_rows):
                    s = Segment({n: batch.column(i)[k].values.to_numpy(zero_copy_only=False) if n not in ("rows", "doc_ids") else batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)})
                    which, at = s.phrases(terms, lengths)
                    hit = np.zeros(len(s.at) + window + 1, np.int64)
                    np.add.at(hit, at, 1)
                    np.add.at(hit, at + lengths[which], -1)
                    pos = np.flatnonzero(np.cumsum(hit) > 0)
                    doc = np.searchsorted(s.starts, pos, "right") - 1
                    counts = np.bincount(doc, minlength=len(s.starts)) if len(pos) else np.zeros(len(s.starts), int)
                    pairs = np.unique(np.stack([np.searchsorted(s.starts, at, "right") - 1, items[which]]), axis=1) if len(at) else np.zeros((2, 0), int)
                    n_items = np.bincount(pairs[0].astype(int), minlength=len(s.starts)) if pairs.size else np.zeros(len(s.starts), int)
                    yield pa.RecordBatch.from_arrays([pa.array(s.rows, pa.int64()), pa.array(s.doc_ids, pa.int64()), pa.array(s.lengths, pa.int64()), lists((pos - s.starts[doc]).astype(np.int32), counts, pa.int32()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_items)]), pa.int32()), ids.take(pa.array(pairs[1].astype(np.int64))))], schema=schema)

        part = index.mapInArrow(find, "row long, doc_id long, n_words long, hits array<int>, items array<long>")
        out = part if out is None else out.unionByName(part)
    return out


def near_matches(index: DataFrame, terms: list[str], distance: int) -> DataFrame:
    """doc_id of each document that has all the words within ``distance`` words of each other."""
    codes = Words(pa.array([" ".join(terms)]), ALNUM, lower=True, key=word_key(index.sparkSession)).hash.view(np.int64)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = Segment({n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(s.near(codes, distance), pa.int64())], ["doc_id"])

    return index.mapInArrow(find, "doc_id long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings), contaminated.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A word is hit if it lies in an
    occurrence of a window of an item. Null and empty texts have no words; items without words have no window. The words of
    an item without item_id are hit as well; it counts as an item of that name: null, which is listed last. Every row is searched for itself: rows that repeat a doc_id, or have none, each get their own answer. An empty table
    gives no rows; other columns are not looked at.
    """
    index = build_index(docs, gap=window)
    parts = blocks(phrase_table(benchmark, window))
    found = search(index, parts, window)
    if len(parts) > 1:
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), names.alias("items"), (F.size("hits") > 0).alias("contaminated"))
