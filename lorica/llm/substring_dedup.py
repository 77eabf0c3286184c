"""Removal of passages that an earlier document has, by suffix automata of reference shards.

A passage is a window of WINDOW consecutive words. Any text can be the reference, so the reference cannot be broadcast
whole; it is dealt to shards such that equal windows always meet: the shard of a window is the smallest hash among its
runs of GRAM words (its minimizer). Neighbouring windows of one minimizer travel as one context of at most
WINDOW + SPREAD - 1 words. Shards of one document are dropped at once. Contexts of equal content are one row, of which
only the earliest document goes on; what is found in it holds at every place where that document has the content. In
each shard that still has different contexts, these pass in order of doc_id:
each is streamed through the suffix automaton of the earlier ones for its matching statistics, marks the maximal
matches of WINDOW words or more, and then extends the automaton. Shards with more contexts than CONTEXTS (thousands of
near copies) are not gathered: their windows are grouped by hash instead, which finds the same windows. Words are told
apart by 64-bit hashes under a key of the application.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, texts, word_key
from .words import NON_SPACE, U64, Words, lists, mix, pieces, runs

WINDOW, GRAM = 50, 20
#: Contexts of a shard that are streamed through one automaton, at most.
CONTEXTS = 256
#: Ids that are broadcast at most to fetch texts (16 bytes each); beyond, Spark deals both sides by doc_id.
BROADCAST_IDS = 4_000_000
_P = U64(0x9E3779B97F4A7C15 | 1)


class SuffixAutomaton:
    """Of sequences of words, each added whole; every state is a set of substrings with the same ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for c in words:
            q = self.next[last].get(c)
            if q is not None:  # an earlier sequence already leads there
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
            last = new

    def matches(self, words: list[int], least: int) -> list[tuple[int, int]]:
        """The maximal spans of words (start, end) of ``least`` words or more that some added sequence has."""
        spans: list[tuple[int, int]] = []
        state = size = 0
        for i, c in enumerate(words):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size >= least:
                start = i + 1 - size
                if spans and spans[-1][1] == i and spans[-1][0] == start:
                    spans[-1] = (start, i + 1)
                else:
                    spans.append((start, i + 1))
        return spans


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def contexts(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shard, document, first window, number of windows) of each context; windows count from the document's start."""
    spread = window - gram + 1
    if len(w.hash) < window:
        return (np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
    low = _sliding_min(runs(w.hash, gram), spread)  # one for each window, borders still ignored
    at = np.arange(len(low))
    docs = w.docs()[: len(low)]
    inside = at + window <= w.first[1:][docs]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (docs[1:] != docs[:-1])
    run_start = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - run_start) % spread == 0  # repetitive text: no context grows beyond the spread
    begin = np.flatnonzero(new & inside)
    ends = np.append(np.flatnonzero(new), len(low))
    stop = ends[np.searchsorted(ends, begin, "right")]
    n_inside = np.concatenate([[0], np.cumsum(inside)])
    return low[begin], docs[begin], begin - w.first[:-1][docs[begin]], n_inside[stop] - n_inside[begin]


def _span_hash(h: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of h[start : start + size], for spans of any size."""
    powers = np.full(len(h) + 1, _P, U64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h) * powers[:-1])])
    inverse = pow(int(_P), -1, 1 << 64)
    back = np.full(len(h) + 1, inverse, U64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((sums[start + size] - sums[start]) * back[start] + size.astype(U64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and key, a hash of the text: together they name a row, also where a doc_id repeats."""
    return texts(docs).where("doc_id is not null").withColumn("key", F.xxhash64("text"))


def _listed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(shard, run, doc_id, key, at, n): all contexts, run naming their content."""
    names, secret = ["shard", "run", "doc_id", "key", "at", "n"], word_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column(1), NON_SPACE, key=secret)
            shard, doc, at, n = contexts(w, window, gram)
            content = _span_hash(w.hash, w.first[:-1][doc] + at, n + window - 1) if len(doc) else shard
            yield pa.RecordBatch.from_arrays([pa.array(shard.view(np.int64)), pa.array(content.view(np.int64)), b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    return _keyed(docs).mapInArrow(run, "shard long, run long, doc_id long, key long, at int, n int")


def _of_docs(docs: DataFrame, wanted: DataFrame, what: list[str]) -> DataFrame:
    """doc_id, key, text and the lists of wanted (doc_id, key, ...), for the rows in wanted."""
    lists_ = keep(wanted.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*what)).alias("wanted")))
    ids = lists_.select("doc_id").distinct()
    if lists_.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return _keyed(docs).join(ids, "doc_id", "left_semi").join(lists_, ["doc_id", "key"]).select("doc_id", "text", "key", "wanted")


def _cut(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(shard, doc_id, key, at, words): the words of the wanted contexts as 64-bit codes."""
    names, secret = ["shard", "doc_id", "key", "at", "words"], word_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column(1), NON_SPACE, key=secret)
            offs = np.asarray(b.column(3).offsets)
            flat = b.column(3).values
            shard, at, n = (flat.field(i).to_numpy() for i in range(3))
            doc = np.repeat(np.arange(b.num_rows), np.diff(offs))
            shard, at, n = (x[offs[0] : offs[-1]] for x in (shard, at, n))
            size = n.astype(np.int64) + window - 1
            ends = np.cumsum(size)
            i = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(w.first[:-1][doc] + at, size)
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column(0).take(pa.array(doc)), b.column(2).take(pa.array(doc)), pa.array(at), lists(w.hash[i].view(np.int64), size, pa.int64())], names)

    return _of_docs(docs, wanted, ["shard", "at", "n"]).mapInArrow(run, "shard long, doc_id long, key long, at int, words array<long>")


_FOUND = "doc_id long, key long, at int, lo int, hi int"


def _streamed(cut: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, at, lo, hi): spans of words of the context at ``at`` that an earlier document of the shard has."""

    def shard_spans(rows: list[tuple[int, int, int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
        out, machine, held, last = [], SuffixAutomaton(), [], None
        for doc, key, at, words in sorted(rows, key=lambda r: r[:3]):
            if doc != last:  # contexts of one document do not count as earlier for each other
                for x in held:
                    machine.add(x)
                held, last = [], doc
            out += [(doc, key, at, at + a, at + b) for a, b in machine.matches(words, window)]
            held.append(words)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def flush() -> pa.RecordBatch:
            found, kinds = shard_spans(rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], ["doc_id", "key", "at", "lo", "hi"])

        for b in batches:
            for shard, *row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != now:
                    if len(rows) > 1:
                        yield flush()
                    now, rows = shard, []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield flush()

    return cut.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, _FOUND)


def _grouped(cut: DataFrame, window: int) -> DataFrame:
    """The same spans for shards of many contexts: every window is a context of its own, and equal ones meet by hash."""
    names = ["h", "doc_id", "key", "at", "lo"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(4)
            offs = np.asarray(col.offsets).astype(np.int64)
            h = mix(col.values.to_numpy().view(U64))
            all_ = runs(h, window)
            n = np.maximum(np.diff(offs) - window + 1, 0)
            ends = np.cumsum(n)
            inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            row = np.repeat(np.arange(b.num_rows), n)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(all_[inner + offs[:-1][row]].view(np.int64)), *(b.column(i).take(of) for i in (1, 2, 3)), pa.array((b.column(3).to_numpy()[row] + inner).astype(np.int32))], names)

    rows = keep(cut.mapInArrow(run, "h long, doc_id long, key long, at int, lo int"))
    first = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    return rows.join(first, "h").where("first < doc_id").select("doc_id", "key", "at", "lo", (F.col("lo") + window).alias("hi"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, key, lo, hi): spans of words, made of windows that a document of smaller doc_id has too."""
    every = _listed(docs, window, gram)
    shared = every.groupBy("shard").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("shard")
    met = keep(every.join(shared, "shard"))
    content = keep(met.groupBy("shard", "run").agg(F.min("doc_id").alias("first")))
    whole = met.join(content, ["shard", "run"]).where("first < doc_id").select("doc_id", "key", F.col("at").alias("lo"), (F.col("at") + F.col("n") + window - 1).alias("hi"))
    many = content.groupBy("shard").agg(F.count("*").alias("contexts")).where("contexts > 1")
    left = met.join(content.join(many, "shard"), ["shard", "run"]).where("first = doc_id")
    left = left.groupBy("shard", "run", "doc_id").agg(F.min(F.struct("key", "at")).alias("one"), F.first("n").alias("n"), F.first("contexts").alias("contexts"), F.count("*").alias("places"))
    left = keep(left.select("shard", "run", "doc_id", "one.key", "one.at", "n", "contexts", "places"))
    few, more = left.where(F.col("contexts") <= CONTEXTS), left.where(F.col("contexts") > CONTEXTS)
    found = _streamed(_cut(docs, few, window), window)
    if not more.isEmpty():
        found = found.union(_grouped(_cut(docs, more, window), window))
    found = keep(found)
    one = left.where("places > 1").select("shard", "run", "doc_id", F.col("key").alias("one_key"), F.col("at").alias("one"))
    again = met.join(one, ["shard", "run", "doc_id"]).where("key <> one_key or at <> one").select("doc_id", F.col("one_key").alias("key"), F.col("one").alias("at"), F.col("key").alias("to"), (F.col("at") - F.col("one")).alias("off"))
    moved = found.join(again, ["doc_id", "key", "at"]).select("doc_id", F.col("to").alias("key"), (F.col("lo") + F.col("off")).alias("lo"), (F.col("hi") + F.col("off")).alias("hi"))
    return whole.union(found.select("doc_id", "key", "lo", "hi")).union(moved)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the other words, joined by one space).

    A word goes if a window that covers it also starts in a document of smaller doc_id; windows are those of the
    input. Null, empty and short texts lose nothing. Every row is judged for itself: rows that repeat a doc_id, with the
    same text or another one, are no reference for each other. Rows without doc_id are kept whole and are no reference.
    An empty table gives no rows; other columns are not looked at.
    """
    names = ["doc_id", "n_words", "n_removed", "kept"]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            spans = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for doc, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), spans, strict=True):
                words = text.encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in own or []:
                    gone[s["lo"]] += 1
                    gone[s["hi"]] -= 1
                stay = np.cumsum(gone)[:-1] == 0
                kept = words if own is None else [x for x, k in zip(words, stay, strict=True) if k]
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    schema = "doc_id long, n_words long, n_removed long, kept string"
    spans = keep(repeated_spans(docs, window, gram).distinct())
    lists_ = keep(spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    if lists_.count() <= BROADCAST_IDS:
        names_ = F.broadcast(lists_.select("doc_id", "key"))
        rows = texts(docs).withColumn("key", F.xxhash64("text"))
        whole = rows.join(names_, ["doc_id", "key"], "left_anti").select("doc_id", "text").mapInArrow(rest, schema)
        some = rows.join(names_, ["doc_id", "key"], "left_semi").join(lists_, ["doc_id", "key"]).select("doc_id", "text", "spans").mapInArrow(rest, schema)
        return whole.unionByName(some)
    rows = texts(docs).withColumn("key", F.xxhash64("text")).join(lists_, ["doc_id", "key"], "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(rest, schema)


#: Bytes of reference shards (as word codes) that are broadcast at once.
BROADCAST_BYTES = 32 << 20


def against_reference(docs: DataFrame, reference: DataFrame, window: int = WINDOW, shard_words: int = 200_000) -> DataFrame:
    """(doc_id, lo, hi): maximal spans of docs that a reference document has. The reference (doc_id, text) is coded and
    dealt to shards of about shard_words words in tasks, stored, and broadcast in blocks of at most BROADCAST_BYTES; a
    task makes each shard a suffix automaton, through which all its documents stream. For references such as lists of
    licences or templates: every block is a pass over docs."""
    spark, secret = docs.sparkSession, word_key(docs.sparkSession)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            w = Words(b.column(1), NON_SPACE, key=secret)
            yield pa.RecordBatch.from_arrays([lists(w.hash.view(np.int64), w.counts(), pa.int64())], ["words"])

    coded = keep(texts(reference).mapInArrow(code, "words array<long>").where(F.size("words") >= window))
    size = coded.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    shards, blocks = max(1, -(-size // shard_words)), max(1, -(-8 * size // BROADCAST_BYTES))
    dealt = coded.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(shards)))
    names, out = ["doc_id", "lo", "hi"], None

    def find(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machines: dict[int, SuffixAutomaton] = {}
            for shard, words in zip(*sent.value, strict=True):
                machines.setdefault(shard, SuffixAutomaton()).add(words.tolist())
            for b in pieces(batches):
                w = Words(b.column(1), NON_SPACE, key=secret)
                h = w.hash.view(np.int64).tolist()
                found = [(d, lo, hi) for d, (a, z) in zip(b.column(0).to_pylist(), zip(w.first[:-1], w.first[1:], strict=True), strict=True) for m in machines.values() for lo, hi in m.matches(h[a:z], window)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names)

        return texts(docs).mapInArrow(run, "doc_id long, lo int, hi int")

    for block in range(blocks):
        rows = dealt.where(F.pmod("shard", F.lit(blocks)) == block).select("shard", "words").toArrow()
        if rows.num_rows:
            part = find(spark.sparkContext.broadcast((rows["shard"].to_pylist(), [x.values.to_numpy() for c in rows["words"].chunks for x in c])))
            out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, lo int, hi int")
