"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(group | history) * P(class | group, history) * P(word | class). The classes are the most frequent
words, the end of a text, and sets of words by their last two bytes; SPLIT classes each are a group. Both choices are
softmaxes of SPLIT over summed weights of hashed n-gram and skip features, so that a token costs two small softmaxes
and not one over all classes; P(word | class) is the smoothed relative frequency. Weights are trained in rounds. The
training texts are dealt once to shards of a given number of tokens by a hash of id and text, and sorted within them, so
that neither the cores of the cluster nor the files of the input change the model. In a round each shard runs gradient
steps over its texts from the weights broadcast, and sends the change of each weight vector with the number of its uses;
the changes are averaged by use, in as many levels as there are powers of FAN shards. The table of contexts grows with
the square root of the vocabulary, and the shards with the table, so that what a round sends stays in proportion.

Word counts cover all training texts. Frequent words (at most FREQUENT of them) are broadcast; all others of a
document are joined to their counts by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, keep, texts
from .words import NON_SPACE, U64, Words, join_hash, lists, pieces

#: Classes: single words, the end, groups by ending; START stands before a text.
SINGLES, GROUPS = 31, 32
END_CLASS, CLASSES, START = 31, 64, 64
#: Classes in a group, and groups. Each feature has one vector for the choice of the group and one for each group.
SPLIT = 8
VECTORS = 1 + CLASSES // SPLIT
END = np.uint64(0xE4D0F7E87000001)
#: Hashed words and pairs of words have 2^BITS rows of the weight table each, in a vocabulary of up to VOCABULARY words;
#: twice as many for each four times as many words, up to 2^MOST_BITS (150 MB of weights).
BITS, VOCABULARY, MOST_BITS = 14, 1 << 22, 18
PAIR, SKIP, WORD = 0, 65 * 65, 65 * 65 + 65 * 65
#: Frequent words that are broadcast at most (16 bytes each).
FREQUENT = 1 << 20
ROUNDS, BATCH, RATE = 2, 8192, 0.3
#: Tokens of a training shard for each hashed word row.
TOKENS_PER_ROW = 256
#: Parts of the weight table that are averaged apart, and changes that are averaged in one place.
PARTS, FAN = 32, 64


def word_bits(vocabulary: int) -> int:
    return min(MOST_BITS, BITS + max(0, (vocabulary // VOCABULARY).bit_length()) // 2)


def rows_of(bits: int) -> int:
    """Rows of the weight table."""
    return WORD + (2 << bits)


@dataclass
class Tokens:
    """The tokens of an Arrow array: words and an end for each text. first: as in Words."""

    hash: np.ndarray
    ending: np.ndarray  # the class by ending alone
    first: np.ndarray

    @staticmethod
    def of(array: pa.Array) -> Tokens:
        w = Words(array, NON_SPACE, lower=True)
        last = w.data[w.end - 1].astype(np.int64) if len(w.end) else np.zeros(0, np.int64)
        before = np.where(w.end - w.start > 1, w.data[np.maximum(w.end - 2, 0)], 0).astype(np.int64) if len(w.end) else last
        group = SINGLES + 1 + (last * 37 + before * 101 + (before >> 3)) % GROUPS
        n = len(array)
        ends = w.first[1:]
        first = w.first + np.arange(n + 1)
        h, c = np.insert(w.hash, ends, END), np.insert(group, ends, END_CLASS)
        return Tokens(h, c, first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def classes(self, singles: np.ndarray) -> np.ndarray:
        """singles: sorted hashes of the words that are classes of their own."""
        if not len(singles):
            return self.ending
        i = np.minimum(np.searchsorted(singles, self.hash), len(singles) - 1)
        return np.where(singles[i] == self.hash, i, self.ending)

    def features(self, classes: np.ndarray, bits: int) -> np.ndarray:
        """Rows of the weight table for each token: the pair of classes before, the classes one and two further back
        (skip), the word before, the two words before."""
        at = np.arange(len(self.hash)) - self.first[:-1][self.docs()]

        def back(x: np.ndarray, k: int, none) -> np.ndarray:
            out = np.full(len(x), none, x.dtype)
            out[k:] = x[:-k] if k else x
            return np.where(at >= k, out, none)

        c1, c2, c3 = (back(classes.astype(np.int64), k, np.int64(START)) for k in (1, 2, 3))
        h1, h2 = (back(self.hash, k, U64(1)) for k in (1, 2))
        low, size = U64((1 << bits) - 1), 1 << bits
        return np.stack([PAIR + c1 * 65 + c2, SKIP + c2 * 65 + c3, WORD + (h1 & low).astype(np.int64), WORD + size + (join_hash(h2, h1) & low).astype(np.int64)], 1)


def _summed(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the vectors in each row of at, less the largest entry of each sum."""
    x = np.take(weights, at[:, 0], axis=0)
    for f in range(1, at.shape[1]):
        x += np.take(weights, at[:, f], axis=0)
    x -= np.maximum.reduce([x[:, k] for k in range(SPLIT)])[:, None]
    return x


def log_choice(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities of the SPLIT options. weights: vectors; at: the vectors to add up, a row for each choice."""
    x = _summed(weights, at)
    return x - np.log(np.exp(x) @ np.ones(SPLIT, np.float32))[:, None]


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log probabilities of all classes after the features in rows."""
    group = log_choice(weights, rows * VECTORS)
    inner = [log_choice(weights, rows * VECTORS + 1 + g) for g in range(CLASSES // SPLIT)]
    return np.concatenate([group[:, g : g + 1] + x for g, x in enumerate(inner)], 1)


def choices(rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, option taken) of both choices of each token: first all groups, then all classes within their groups."""
    group = classes // SPLIT
    base = rows * VECTORS
    return np.concatenate([base, base + 1 + group[:, None]]), np.concatenate([group, classes % SPLIT])


def step(weights: np.ndarray, square: np.ndarray, uses: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
    """One AdaGrad step (one rate per vector) over a batch, in place."""
    at, taken = choices(rows, classes)
    g = np.exp(_summed(weights, at))
    g /= (g @ np.ones(SPLIT, np.float32))[:, None]
    n_choices = np.arange(len(g))
    g[n_choices, taken] -= 1
    bits = max(1, len(g).bit_length())
    for f in range(at.shape[1]):
        key = np.sort((at[:, f] << bits) | n_choices)  # a stable order by vector
        r = key >> bits
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        own, n = r[first], np.diff(np.append(first, len(r)))
        total = np.add.reduceat(np.take(g, key & ((1 << bits) - 1), axis=0), first, axis=0)
        size = n.astype(np.float32)  # the sums count divided by its root
        new = square[own] + np.einsum("ij,ij->i", total, total) / (8 * size)
        square[own] = new
        total *= (-RATE / 2 / np.sqrt((new + np.float32(1e-3)) * size))[:, None]
        weights[own] = np.take(weights, own, axis=0) + total
        uses[own] += n


def word_counts(train: DataFrame) -> DataFrame:
    """(h, ending, c): how often each token occurs in the texts, stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, limit=4 << 20):
            t = Tokens.of(b.column(1))
            h, at, n = np.unique(t.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t.ending[at].astype(np.int32)), pa.array(n)], ["h", "ending", "c"])

    return keep(train.mapInArrow(count, "h long, ending int, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c")))


def sharded(train: DataFrame, tokens: int, bits: int) -> tuple[DataFrame, int]:
    """(doc_id, text, shard) and the number of shards, stored so that a shard lies in one row group of one file, which one
    task reads."""
    shards = max(1, int(-(-tokens // (TOKENS_PER_ROW * (1 << bits)))))
    key = F.xxhash64("doc_id", "text")
    dealt = train.select("doc_id", "text", F.pmod(key, F.lit(shards)).cast("int").alias("shard"))
    return keep(dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("text", "doc_id"))), shards


def _averaged(changes: DataFrame, shards: int, total: int) -> DataFrame:
    """(part, mean): of changes (part, source, uses, change), both summed over FAN sources at a time until one is left."""
    size = -(-total // PARTS)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, x = None, np.zeros(0), np.zeros(0)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.arange(size, dtype=np.int32).tobytes()]), pa.array([n.astype(np.float32).tobytes()]), pa.array([(x / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()])], _CHANGE)

        for b in batches:
            for part, group, at, uses, change in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if key != (part, group):
                    if key:
                        yield out()
                    key, n, x = (part, group), np.zeros(size), np.zeros((size, SPLIT))
                at, uses = np.frombuffer(at, np.int32), np.frombuffer(uses, np.float32).astype(np.float64)
                n[at] += uses
                x[at] += np.frombuffer(change, np.float16 if len(change) == 2 * SPLIT * len(at) else np.float32).reshape(-1, SPLIT) * uses[:, None]
        if key:
            yield out()

    while True:
        grouped = changes.select("part", F.floor(F.col("source") / FAN).cast("int").alias("grp"), "at", "uses", "change", "source")
        changes = grouped.repartition("part", "grp").sortWithinPartitions("part", "grp", "source").drop("source").mapInArrow(add, _CHANGES)
        shards = -(-shards // FAN)
        if shards == 1:
            return changes.select("part", F.col("change").alias("mean"))


_CHANGE = ["part", "source", "at", "uses", "change"]
_CHANGES = "part int, source int, at binary, uses binary, change binary"


def _round(train: DataFrame, shards: int, weights: np.ndarray, singles: np.ndarray, bits: int) -> np.ndarray:
    sent = train.sparkSession.sparkContext.broadcast((weights, singles))
    total = rows_of(bits) * VECTORS

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, own = sent.value
        shard, w, square, uses = None, start, np.zeros(0), np.zeros(0)

        def changes() -> Iterator[pa.RecordBatch]:
            for i in range(PARTS):
                used = np.flatnonzero(uses[i::PARTS])
                at = used * PARTS + i
                change = (w[at] - start[at]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([shard], pa.int32()), pa.array([used.astype(np.int32).tobytes()]), pa.array([uses[at].astype(np.float32).tobytes()]), pa.array([change.tobytes()])], _CHANGE)

        for whole in pieces(batches):
            of = whole.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1), len(of)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                b = whole.slice(lo, hi - lo)
                if shard != of[lo]:
                    if shard is not None:
                        yield from changes()
                    shard, w, square, uses = int(of[lo]), start.copy(), np.zeros(total, np.float32), np.zeros(total, np.int64)
                t = Tokens.of(b.column(1))
                c = t.classes(own)
                rows = t.features(c, bits)
                for i in range(0, len(c), BATCH):
                    step(w, square, uses, rows[i : i + BATCH], c[i : i + BATCH])
        if shard is not None:
            yield from changes()

    out = weights.copy()
    for r in _averaged(train.mapInArrow(learn, _CHANGES), shards, total).toArrow().to_pylist():  # PARTS rows, together as large as the weights
        own = out[r["part"] :: PARTS]
        own += np.frombuffer(r["mean"], np.float32).reshape(-1, SPLIT)[: len(own)]
    return out


@dataclass
class Model:
    weights: np.ndarray
    singles: np.ndarray
    class_log: np.ndarray  # log10 of the smoothed size of each class
    frequent: np.ndarray  # sorted hashes
    frequent_counts: np.ndarray
    tokens: int
    distinct: int
    bits: int


def train_model(train: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the table of counts, from doc_id and text of the training rows."""
    counts = word_counts(train)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    best = counts.where(F.col("ending") != END_CLASS).orderBy(F.col("c").desc(), "h").limit(SINGLES).collect()
    singles = np.sort(np.array([r["h"] for r in best], np.int64).view(np.uint64))
    place = {int(h.view(np.int64)): i for i, h in enumerate(singles)}
    own: Column = F.col("ending")
    for h, i in place.items():
        own = F.when(F.col("h") == h, F.lit(i)).otherwise(own)
    sizes = np.zeros((CLASSES, 2))
    for r in counts.groupBy(own.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        sizes[r["k"]] = r["c"], r["v"]
    levels = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2(F.col("c").cast("double"))).alias("k")).agg(F.count("*").alias("n")).collect()}
    level = max(levels, default=0) + 1
    while level > 0 and sum(n for k, n in levels.items() if k >= level - 1) <= FREQUENT:
        level -= 1
    often = counts.where(F.col("c") >= 2**level).select("h", "c").toArrow()
    h = often["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    bits = word_bits(total["v"])
    weights = np.zeros((rows_of(bits) * VECTORS, SPLIT), np.float32)
    dealt, shards = sharded(train, total["n"], bits)
    for _ in range(rounds):
        weights = _round(dealt, shards, weights, singles, bits)
    drop(dealt)
    return Model(weights, singles, np.log10(sizes[:, 0] + 0.5 * (sizes[:, 1] + 1)), h[order], often["c"].to_numpy()[order], total["n"], total["v"], bits), counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score (add-half unigrams, log10), score (the
    model's log10 probability). Null texts are the end alone; rows that repeat a doc_id are scored one by one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "doc_id", "n_tokens", "n_known", "logs", "model", "rest", "times"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, done = sent.value, TaskContext.get().partitionId(), 0
        for b in pieces(batches):
            t, n = Tokens.of(b.column(1)), b.num_rows
            docs_, c = t.docs(), t.classes(m.singles)
            rows, logs = t.features(c, m.bits), np.empty(len(c))
            for i in range(0, len(c), BATCH):
                at, taken = choices(rows[i : i + BATCH], c[i : i + BATCH])
                p = log_choice(m.weights, at)[np.arange(len(at)), taken]
                logs[i : i + BATCH] = p[: len(p) // 2] + p[len(p) // 2 :]
            by_class = np.bincount(docs_, logs / np.log(10) - m.class_log[c], minlength=n)
            own, word = np.unique(t.hash, return_inverse=True)
            i = np.minimum(np.searchsorted(m.frequent, own), max(len(m.frequent) - 1, 0))
            often = m.frequent[i] == own if len(m.frequent) else np.zeros(len(own), bool)
            log = np.where(often, np.log10(m.frequent_counts[i] + 0.5), 0.0) if len(m.frequent) else np.zeros(len(own))
            known, sums = np.bincount(docs_, often[word], minlength=n), np.bincount(docs_, log[word], minlength=n)
            seldom = ~often[word]
            pair, times = np.unique(docs_[seldom] * len(own) + word[seldom], return_counts=True)
            per = np.bincount(pair // len(own), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(done, done + n) + (part << 40)), b.column(0), pa.array(np.diff(t.first), pa.int64()), pa.array(known.astype(np.int64)), pa.array(sums), pa.array(by_class)]
                + [lists(own[pair % len(own)].view(np.int64), per, pa.int64()), lists(times, per, pa.int64())], names)
            done += n

    rated = keep(texts(docs).mapInArrow(rate, "row long, doc_id long, n_tokens long, n_known long, logs double, model double, rest array<long>, times array<long>"))
    rest = rated.select("row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("row", F.col("r.rest").alias("h"), F.col("r.times").cast("int").alias("times"))
    c = F.coalesce("c", F.lit(0))
    found = rest.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(F.col("times") * F.log10(c + 0.5)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    out = rated.drop("rest", "times").join(found, "row", "left")
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + 0.5 * (model.distinct + 1))))).alias("base_score"), (logs + F.col("model")).alias("score"))
