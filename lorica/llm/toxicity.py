"""Toxicity scores of restored text: a noisy channel in front of a linear model.

Tokens that look disguised (letters mixed with look-alike digits and signs, letters repeated three times or more,
words spelled with spaces or marks between the letters) become lattices of the letters that they may stand for. The
Viterbi path through a lattice under a character trigram model, counted over all documents, is the restored word. A
document's words and restored words, and the beginnings of words, are the features of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import fold, keep, texts
from .words import ALNUM, NON_SPACE, U64, Words, join_hash, lists, pieces, span_hashes

#: Letters that a sign may stand for. Fixed values.
LOOKS_LIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "+": "t", "|": "il", "!": "i"}
SEPARATORS = " .-_*'"
#: Costs (nats) of the channel: a sign for a letter, a letter said twice or more for one, a mark between letters.
SIGN, DOUBLED, STRETCHED, MARK, SPACE = 1.0, 3.0, 0.3, 0.3, 2.0

OTHER, EDGE, SYMBOLS = 26, 27, 28
PREFIXES = (4, 5, 6)
#: Rows of labels that are broadcast at most (about 20 bytes each).
BROADCAST_LABELS = 2_000_000
#: A feature counts from MIN_DOCS toxic documents on.
MIN_DOCS, MIN_ODDS = 3, 2.0
#: Features that are broadcast at most (16 bytes each): those that say most. The others are joined.
BROADCAST_FEATURES = 500_000
#: Bytes of text that a task looks at together, and those for which it hands on the features' counts together. Both
#: Python workers of an executor stand beside its JVM, so what a piece takes counts twice.
PIECE, COUNTED = 1 << 20, 4 << 20

_CODE = np.full(256, EDGE, np.int16)  # so are three symbols as one number: SYMBOLS**3 < 2**15
_CODE[128:] = OTHER
_CODE[97:123] = _CODE[65:91] = np.arange(26)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_PLAIN = ALNUM
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS_LIKE]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in SEPARATORS if c != " "]] = True


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each three characters follow each other in all the texts (28 symbols: a-z, other letters, edge)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for b in pieces(batches, limit=PIECE):
            w = Words(b.column(1), ALNUM, lower=True)
            p = np.insert(_CODE[w.data], np.repeat(np.unique(w.offsets), 2), EDGE)  # each text between edges of its own
            total += np.bincount((p[:-2] * SYMBOLS + p[1:-1]) * SYMBOLS + p[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["three", "n"])

    rows = texts(docs).mapInArrow(count, "three int, n long").groupBy("three").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3)
    out[rows["three"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def character_model(counts: np.ndarray) -> np.ndarray:
    """Cost (nats) of the third character after two, mixed with the pair model so that new threes stay possible."""
    pair = (counts.sum(0) + 0.5) / (counts.sum(0) + 0.5).sum(-1, keepdims=True)
    return -np.log((counts + 2.0 * pair[None]) / (counts.sum(-1, keepdims=True) + 2.0))


def _symbol(c: str) -> int:
    return ord(c) - 97 if "a" <= c <= "z" else OTHER if c.isalpha() else EDGE


def lattice(token: str) -> list[list[tuple[float, str]]]:
    """For each run of equal characters the (cost, letters) that it may stand for."""
    out = []
    for m in re.finditer(r"(?s)(.)\1*", token.lower()):
        c, n = m[1], len(m[0])
        if c in SEPARATORS:
            out.append([(MARK, "")] + ([(SPACE, " ")] if c == " " else []))
            continue
        options = [(0.0, c)] if c.isalpha() else [(SIGN, x) for x in LOOKS_LIKE.get(c, "")] or [(0.0, " ")]
        if n == 1:
            out.append(options)
        else:
            fewer = DOUBLED if n == 2 else STRETCHED
            out.append([(cost + fewer, x) for cost, x in options] + [(cost * 2 + (0 if n == 2 else STRETCHED), x * 2) for cost, x in options])
    return out


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a disguised token: the Viterbi path through its lattice."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(EDGE, EDGE): (0.0, ())}
    for options in lattice(token):
        reached: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, said) in best.items():
            for channel, letters in options:
                x, y, total, path = a, b, cost + channel, said
                for c in letters:
                    s = _symbol(c)
                    total += model[x, y, s]
                    x, y, path = y, s, (path, c)
                if (x, y) not in reached or total < reached[x, y][0]:
                    reached[x, y] = (total, path)
        best = reached
    _, said = min((cost + model[a, b, EDGE], said) for (a, b), (cost, said) in best.items())
    out = []
    while said:
        said, c = said
        out.append(c)
    return "".join(reversed(out))


def disguised(w: Words) -> list[tuple[int, int, int]]:
    """(document, first word, last word + 1) of the tokens to restore; words are split at white space alone."""
    if not len(w.start):
        return []
    data, docs = w.data, w.docs()

    def inside(flag: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each word how many of its bytes before end have the flag. One array of counts at a time, of 4 bytes for a
        byte of text, of which an Arrow array has less than 2**31."""
        upto = np.zeros(len(flag) + 1, np.int32)
        np.cumsum(flag, dtype=np.int32, out=upto[1:])
        return upto[end] - upto[w.start]

    last = np.where(_PLAIN[data], np.arange(len(data), dtype=np.int32), np.int32(0))
    last = np.maximum.accumulate(last, out=last)[w.end - 1] + 1
    ends = np.where((w.end - last >= 2) | _MARK[data[w.end - 1]] | (data[w.end - 1] == 33), np.maximum(last, w.start), w.end)  # marks at the end say nothing
    n_letters, size = inside(_LETTER[data], w.end), w.end - w.start
    mixed = (n_letters >= 1) & (inside(_SIGN[data], ends) >= 1) & (size <= 3 * n_letters + 3)
    dotted = (n_letters >= 3) & (inside(_MARK[data], ends) >= n_letters - 1)
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    stretched = inside(same, w.end) >= 1
    single = (size == 1) & (_LETTER | _SIGN)[data[w.start]]
    found = [(int(docs[i]), int(i), int(i) + 1) for i in np.flatnonzero((mixed | dotted | stretched) & ~single)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]]).astype(np.int8)))
    for a, b in edge.reshape(-1, 2):
        cuts = [a, *(np.flatnonzero(np.diff(docs[a:b])) + a + 1), b]
        found += [(int(docs[x]), int(x), int(y)) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= 3]
    return found


def restored(array: pa.Array, model: np.ndarray, memo: dict[bytes, str]) -> list[str]:
    """For each text the restored words, joined by spaces."""
    w = Words(array, NON_SPACE)
    out: list[list[str]] = [[] for _ in range(len(array))]
    for doc, a, b in disguised(w):
        token = w.data[w.start[a] : w.end[b - 1]].tobytes() if b == a + 1 else b" ".join(w.text(i) for i in range(a, b))
        if token not in memo:
            if len(memo) > 100_000:
                memo.clear()
            memo[token] = restore(re.sub(r"[^\w\s]{2,}$", "", token.decode()), model)
        out[doc].append(memo[token])
    return [" ".join(x) for x in out]


def features(array: pa.Array, model: np.ndarray, memo: dict[bytes, str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) without repeats: hashes of words, of restored words and of the beginnings of both.
    wanted: sorted hashes, to which the features are kept."""
    docs, hashes = [], []
    for w in (Words(array, ALNUM, lower=True), Words(pa.array(restored(array, model, memo), pa.large_string()), ALNUM, lower=True)):
        own, at, word = np.unique(w.hash, return_index=True, return_inverse=True)
        size, of, h = (w.end - w.start)[at], [np.arange(len(own))], [own]
        for n in PREFIXES:
            long = np.flatnonzero(size > n)
            of.append(long)
            h.append(join_hash(span_hashes(w.data, w.start[at[long]], w.start[at[long]] + n), np.full(len(long), n, U64)))
        of, h = np.concatenate(of), np.concatenate(h)
        if wanted is not None:
            hit = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
            of, h = of[hit], h[hit]
        order = np.argsort(of, kind="stable")
        of, h, n = of[order], h[order], np.bincount(of, minlength=len(own))
        used = n[word] > 0
        pair = np.unique(w.docs()[used] * max(len(own), 1) + word[used])
        doc, word = pair // max(len(own), 1), pair % max(len(own), 1)
        ends = np.cumsum(n[word])
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n[word], n[word]) + np.repeat((np.cumsum(n) - n)[word], n[word])
        docs.append(np.repeat(doc, n[word]))
        hashes.append(h[at])
    known, code = np.unique(np.concatenate(hashes), return_inverse=True)
    pair = np.unique(np.concatenate(docs) * max(len(known), 1) + code)
    return pair // max(len(known), 1), known[pair % max(len(known), 1)]


@dataclass
class Model:
    """Character costs, the features (sorted hashes) and their weights, and the slope and bias of the score.
    rest: the features (h, w) beyond those that are broadcast, if there are any."""

    characters: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    bias: float = 0.0
    rest: DataFrame | None = None

    def evidence(self, array: pa.Array, memo: dict[bytes, str]) -> np.ndarray:
        d, h = features(array, self.characters, memo, self.hashes)
        return np.minimum(np.bincount(d, self.weights[np.searchsorted(self.hashes, h)], minlength=len(array)), 40.0)


def counted(batches: Iterator[pa.RecordBatch], characters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """h, t, c: each feature (hash) of batches (doc_id, text, toxic) with the toxic and the other documents that have it,
    once for about COUNTED bytes of text."""
    memo: dict[bytes, str] = {}
    held: list[tuple[np.ndarray, ...]] = []

    def summed(h: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        uniq, inverse = np.unique(h, return_inverse=True)
        return uniq, *(np.bincount(inverse, x, minlength=len(uniq)).astype(np.int64) for x in (t, n))

    def out() -> pa.RecordBatch:
        h, t, n = summed(*map(np.concatenate, zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(t), pa.array(n - t)], ["h", "t", "c"])

    size = 0
    for b in pieces(batches, limit=PIECE):
        d, h = features(b.column(1), characters, memo)
        held.append(summed(h, b.column(2).to_numpy()[d], np.ones(len(d), np.int64)))
        size += b.column(1).nbytes
        if size >= COUNTED:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def train(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (5, 0)) -> Model:
    """Character counts from all texts; weights from the labelled rows outside the held-out fold alone.

    A weight is the log odds of a feature's document frequencies among toxic and other rows; slope and bias are then
    fitted by Newton's method to a histogram of the summed weights. Rows without label (or a null one) teach nothing.
    """
    characters = character_model(character_counts(docs))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = keep(marked)
    if marked.count() <= BROADCAST_LABELS:
        marked = F.broadcast(marked)  # else Spark deals both sides by doc_id
    rows = texts(docs).join(marked, "doc_id").where(~fold("doc_id", held_out[0], (held_out[1],)))
    sent = docs.sparkSession.sparkContext.broadcast(characters)

    rows = keep(rows.select("doc_id", "text", "toxic"))
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, clean = n["t"], n["n"] - n["t"]
    odds = F.log((F.col("t") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(clean + 1.0))
    weighed = rows.mapInArrow(lambda batches: counted(batches, sent.value), "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_DOCS).withColumn("w", odds).where(F.col("w") >= MIN_ODDS)
    weighed, rest = keep(weighed), None
    first = weighed.select("h", "w")
    if weighed.count() > BROADCAST_FEATURES:
        first = keep(weighed.orderBy((F.col("t") * F.col("w")).desc(), "h").limit(BROADCAST_FEATURES).select("h", "w"))
        rest = keep(weighed.select("h", "w").join(first, "h", "left_anti"))
    top = first.toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = Model(characters, h[order], top["w"].to_numpy()[order])
    known = docs.sparkSession.sparkContext.broadcast(model)
    model = replace(model, rest=rest)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, str] = {}
        for b in pieces(batches, limit=PIECE):
            x = known.value.evidence(b.column(1), memo)
            yield pa.RecordBatch.from_arrays([pa.array(np.round(x * 4).astype(np.int32)), pa.array(b.column(2).to_numpy().astype(np.int32))], ["x", "toxic"])

    rated = rows.mapInArrow(rate, "x int, toxic int") if rest is None else _joined(rows, model, "toxic").select(F.rint(F.col("x") * 4).cast("int").alias("x"), "toxic")
    seen = rated.groupBy("x", "toxic").count().toArrow()
    model.slope, model.bias = logistic(seen["x"].to_numpy() / 4, seen["toxic"].to_numpy(), seen["count"].to_numpy())
    return model


def _joined(rows: DataFrame, model: Model, *others: str) -> DataFrame:
    """doc_id, the other columns (int) and x, the evidence, for a model with features that are not broadcast."""
    sent = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))
    names = ["row", "doc_id", *others, "x", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for b in pieces(batches, limit=PIECE):
            d, h = features(b.column(2), m.characters, memo)
            at = np.minimum(np.searchsorted(m.hashes, h), max(len(m.hashes) - 1, 0))
            hit = m.hashes[at] == h if len(m.hashes) else np.zeros(len(h), bool)
            x = np.bincount(d[hit], m.weights[at[hit]], minlength=b.num_rows)
            more = lists(h[~hit].view(np.int64), np.bincount(d[~hit], minlength=b.num_rows), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(b.column(i) for i in range(3, b.num_columns)), pa.array(x.astype(float)), more], names)

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", *(F.col(c).cast("int").alias(c) for c in others))
    found = keep(numbered.mapInArrow(run, ", ".join(["row long, doc_id long", *(f"{c} int" for c in others), "x double, h array<long>"])))
    more = found.select("row", F.explode("h").alias("h")).join(model.rest, "h").groupBy("row").agg(F.sum("w").alias("more"))
    return found.join(more, "row", "left").select("doc_id", *others, F.least(F.col("x") + F.coalesce("more", F.lit(0.0)), F.lit(40.0)).alias("x"))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic curve through counted points, slightly drawn to (1, -1)."""
    w, prior, pull = np.array([1.0, -1.0]), np.array([1.0, -1.0]), np.array([1e-2, 1e-2])
    design = np.stack([x, np.ones(len(x))], 1) if len(x) else np.zeros((0, 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (n * (p - y)) + pull * (w - prior)
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag(pull), g)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 from 0.5 on). Null and empty texts get the score of
    no evidence; rows that repeat a doc_id are scored one by one."""
    if model.rest is not None:
        x = F.lit(model.slope) * F.col("x") + F.lit(model.bias)
        return _joined(texts(docs), model).select("doc_id", (1 / (1 + F.exp(-x))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = sent.value, {}
        for b in pieces(batches, limit=PIECE):
            x = m.evidence(b.column(1), memo)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-(m.slope * x + m.bias))))], ["doc_id", "score"])

    return texts(docs).mapInArrow(rate, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def restored_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the restored words of each document (empty if nothing is disguised)."""
    sent = docs.sparkSession.sparkContext.broadcast(model.characters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, str] = {}
        for b in pieces(batches, limit=PIECE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(restored(b.column(1), sent.value, memo), pa.string())], ["doc_id", "restored"])

    return texts(docs).mapInArrow(run, "doc_id long, restored string")
