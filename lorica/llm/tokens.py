"""Token counts and ids of whole texts, from distinct pre-tokens.

Counts: the distinct pre-tokens of all documents are one table, in which each is encoded once; it is joined to the
documents' frequencies. Ids (see packing): a task encodes a pre-token once as long as its worker remembers it.

A pre-token is a run of bytes other than ASCII white space, or the marks at its end. The tokenizer must keep white space apart (it drops it or
never merges across it), which is checked when it is loaded; then a text's tokens are those of its pre-tokens, one
after the other.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, texts
from .words import LOWER, NON_SPACE, Words, distinct_spans, lists, pieces, span_hashes

#: Bytes of pre-tokens that are broadcast with their counts at most (ENTRY bytes each besides their own).
BROADCAST_BYTES, ENTRY = 128 << 20, 24
#: Bytes of a pre-token that is told apart by its bytes; a longer one goes by its SHA-256 behind a byte that no text has.
SHORT = 64

#: Bytes of distinct pre-tokens (HELD bytes each besides their own) that a task remembers, and those that its Python
#: worker keeps beyond and after the task: the ones met first, among them the frequent ones. Longer ones than LONGEST
#: are not remembered.
REMEMBERED, KEPT, HELD, LONGEST = 96 << 20, 24 << 20, 160, 1024


def named(token: bytes) -> bytes:
    return token if len(token) <= SHORT else b"\xff" + hashlib.sha256(token).digest()


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use all cores
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    ids = lambda s: tok.encode(s, add_special_tokens=False).ids
    if ids("ab \t\ncd  e") != ids("ab") + ids("cd") + ids("e"):
        raise ValueError(f"{path}: white space is not a border of tokens")
    return tok


#: ASCII marks: neither letter, digit nor white space.
MARK = np.zeros(256, bool)
MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
ASCII_ALNUM = np.zeros(256, bool)
ASCII_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class Units:
    """The texts of an Arrow array as pre-tokens: words, with the marks that end a word apart where the tokenizer has
    a border anyway (after an ASCII letter or digit or a letter of Latin-1), and A-Z lower-cased, as the tokenizer does,
    unless a special token may be near."""

    def __init__(self, array: pa.Array, lower: bool):
        w = Words(array, NON_SPACE)
        self.n_words, self.n_bytes = w.counts(), np.diff(w.offsets)
        data = LOWER[w.data] if lower else w.data.copy()
        opens = np.concatenate([[0], np.cumsum(w.data == 60)])
        special = opens[w.end] > opens[w.start]
        for a, b in zip(w.start[special], w.end[special], strict=True):
            data[a:b] = w.data[a:b]
        last = np.maximum.accumulate(np.where(MARK[data], -1, np.arange(len(data)))) if len(data) else np.zeros(0, int)
        core = last[w.end - 1] if len(data) else last
        back = data[np.maximum(core - 1, 0)] if len(data) else data
        own = data[np.maximum(core, 0)] if len(data) else data
        split = ~special & (core >= w.start) & (core + 1 < w.end) & (ASCII_ALNUM[own] | ((core > w.start) & (back == 0xC3) & (own >= 0x80) & (own != 0x97) & (own != 0xB7)))
        rep = np.repeat(np.arange(len(split)), 1 + split)
        second = np.zeros(len(rep), bool)
        second[1:] = rep[1:] == rep[:-1]
        self.start = np.where(second, core[rep] + 1, w.start[rep])
        self.end = np.where(split[rep] & ~second, core[rep] + 1, w.end[rep])
        self.data, self.hash = data, span_hashes(data, self.start, self.end)
        self.first = np.concatenate([[0], np.cumsum(1 + split)])[w.first]

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def distinct(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(the distinct pre-tokens, their hashes, for each pre-token which of them it is), told apart by their bytes."""
        at, content = distinct_spans(self.data, self.start, self.end, self.hash)
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)], self.hash[at], content


_KNOWN: dict[tuple, Pieces] = {}


class Pieces:
    """Ids (as bytes of unsigned 32-bit numbers), or only their number, of each distinct pre-token; a pre-token is
    encoded once as long as a Python worker remembers it."""

    def __init__(self, path: str, ids: bool):
        self.tok, self.ids, self.seen, self.bytes = load(path), ids, {}, 0
        self.encode = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        lower = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.lower = lower("AbC") == lower("abc")

    @staticmethod
    def known(path: str, ids: bool = False) -> Pieces:
        if (path, ids) not in _KNOWN:
            _KNOWN[path, ids] = Pieces(path, ids)
        return _KNOWN[path, ids]

    def _encoded(self, words: list[str]) -> list[np.ndarray]:
        """Words of plain letters go many to a text: their ids end where an id ends a word."""
        plain = [i for i, x in enumerate(words) if x.isalpha() and max(x) <= "\xff"] if self.ends.any() else []
        out: list = [None] * len(words)
        for batch in (plain[i : i + 400] for i in range(0, len(plain), 400)):
            ids = np.array(self.encode([" ".join(words[i] for i in batch)], add_special_tokens=False)[0].ids, np.uint32)
            parts = np.split(ids, np.flatnonzero(self.ends[ids]) + 1)[:-1]
            if len(parts) == len(batch):
                for i, x in zip(batch, parts, strict=True):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.encode([words[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, np.uint32)
        return out

    def remember(self, token: bytes, what: bytes | int) -> None:
        if len(token) <= LONGEST:
            self.seen[token] = what
            self.bytes += HELD + len(token) + (len(what) if self.ids else 0)

    def forget(self) -> None:
        before, self.seen, self.bytes = self.seen, {}, 0
        for token, what in before.items():
            if self.bytes > KEPT:
                break
            self.remember(token, what)

    def of(self, units: Units) -> tuple[np.ndarray, list]:
        """(for each unit the index of its pre-token, what each distinct pre-token has)."""
        keys, _, inverse = units.distinct()
        got = list(map(self.seen.get, keys))
        new = [i for i, x in enumerate(got) if x is None]
        if new:
            if self.bytes > REMEMBERED:
                self.forget()
            for i, x in zip(new, self._encoded([str(keys[i], "utf-8") for i in new]), strict=True):
                got[i] = x.tobytes() if self.ids else len(x)
                self.remember(keys[i], got[i])
        return inverse, got


def distinct_tokens(docs: DataFrame, path: str) -> DataFrame:
    """(token, c, n): each distinct pre-token of all the texts once (see named()), in how many batches of texts it was met,
    and its number of ids; stored."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, held, size = Pieces.known(path).lower, Counter(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])

        for b in pieces(batches, limit=4 << 20):
            tokens, known = Units(b.column(1), lower).distinct()[0], len(held)
            held.update(tokens)
            if len(held) > known:  # dicts keep their order: what is new stands last
                size += sum(HELD + len(t) for t in islice(held, known, None))
            if size > REMEMBERED // 2:
                yield out()
                held.clear()
                size = 0
        yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces.known(path)
        for b in batches:
            tokens = b.column(0).to_pylist()
            n = [len(x) for x in known._encoded([str(t, "utf-8") for t in tokens])]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(named, tokens)), pa.binary()), b.column(1), pa.array(n, pa.int32())], ["token", "c", "n"])

    tokens = texts(docs).mapInArrow(met, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))
    return keep(tokens.mapInArrow(encode, "token binary, c long, n int"))


@dataclass
class Frequent:
    """Pre-tokens by ascending hash, and their numbers of ids."""

    hash: np.ndarray
    token: pa.Array
    n: np.ndarray

    @staticmethod
    def of(rows: pa.Table) -> Frequent:
        token = rows["token"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = token.buffers()
        offs = np.frombuffer(offsets, np.int64)[token.offset : token.offset + len(token) + 1] if len(token) else np.zeros(1, np.int64)
        h = span_hashes(np.frombuffer(data or b"", np.uint8), offs[:-1], offs[1:])
        at = np.argsort(h, kind="stable")
        return Frequent(h[at], token.take(pa.array(at)), rows["n"].to_numpy()[at].astype(np.int64))

    def find(self, keys: list[bytes], h: np.ndarray) -> np.ndarray:
        """The number of ids of each, -1 for those that are not among these. Bytes are compared, not hashes alone."""
        if not len(self.n):
            return np.full(len(keys), -1)
        i = np.minimum(np.searchsorted(self.hash, h), len(self.n) - 1)
        same = pc.equal(self.token.take(pa.array(i)), pa.array(keys, pa.large_binary())).to_numpy(zero_copy_only=False)
        return np.where(same, self.n[i], -1)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_words, n_tokens, over_limit (n_tokens > limit).

    The pieces of each distinct pre-token of all documents are counted once. These counts are joined to the frequencies
    of the pre-tokens in each document and summed: the ones met most, of BROADCAST_BYTES in all, are broadcast, those beyond
    are joined by their bytes, and long ones by their digests. No ids are kept. Null texts count as empty (0 tokens). Rows are counted one by one: repeated ids, null
    ids and repeated rows each have a row of their own; an empty table gives none; other columns are not looked at.
    """
    counts = distinct_tokens(docs, path)
    short = F.hex(F.substring("token", 1, 1)) != "FF"  # else it is a digest
    levels = {(r["k"], r["short"]): r["bytes"] for r in counts.groupBy(F.floor(F.log2(F.col("c").cast("double"))).alias("k"), short.alias("short")).agg(F.sum(F.octet_length("token") + ENTRY).alias("bytes")).collect()}
    least = 0
    while sum(n for (k, s), n in levels.items() if s and k >= least) > BROADCAST_BYTES:
        least += 1
    all_sent = not least and all(s for _, s in levels)
    sent = docs.sparkSession.sparkContext.broadcast(Frequent.of(counts.where((F.col("c") >= 2**least) & short).select("token", "n").toArrow()))
    names = ["row", "doc_id", "n_bytes", "n_words", "n_tokens", "rest", "times"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower, row = Pieces.known(path).lower, TaskContext.get().partitionId() << 40
        for b in pieces(batches):
            w, rows = Units(b.column(1), lower), b.num_rows
            keys, h, token = w.distinct()
            n = sent.value.find(keys, h)
            pair, freq = np.unique(w.docs() * max(len(n), 1) + token, return_counts=True)  # per-document frequencies
            doc, token = pair // max(len(n), 1), pair % max(len(n), 1)
            known = n[token] >= 0 if len(n) else np.zeros(0, bool)
            sums = np.bincount(doc[known], n[token[known]] * freq[known], minlength=rows) if len(n) else np.zeros(rows)
            per, other = np.bincount(doc[~known], minlength=rows), token[~known]
            offs = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            own, at = np.unique(other, return_inverse=True)
            rest = pa.ListArray.from_arrays(offs, pa.array([named(keys[i]) for i in own], pa.binary()).take(pa.array(at)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + rows)), b.column(0), pa.array(w.n_bytes), pa.array(w.n_words, pa.int64()), pa.array(sums.astype(np.int64)), rest, lists(freq[~known], per, pa.int64())], names)
            row += rows

    counted = texts(docs).mapInArrow(count, "row long, doc_id long, n_bytes long, n_words long, n_tokens long, rest array<binary>, times array<long>")
    if not all_sent:
        counted = keep(counted)
        rest = counted.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("token"), F.col("r.times").alias("times"))
        unsent = counts.where((F.col("c") < 2**least) | ~short).select("token", "n")
        more = rest.join(unsent, "token").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more"))
        counted = counted.join(more, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return counted.select("doc_id", "n_bytes", "n_words", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
