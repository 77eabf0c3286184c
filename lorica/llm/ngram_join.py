"""Jaccard self-join of documents on sets of word n-grams, by rare-first prefix filtering.

Documents of equal sets are one class (a node), of which one row is compared. Every set's n-grams are put in one global
order, rare ones first: counts of the frequent ones come from a hashed table of counters summed over all documents, all
others are ordered by hash. Two different sets with Jaccard similarity of at least 3/4 share COMMON n-grams among their
first quarter and one. Only n-grams of such prefixes move. Where an n-gram's rows meet, sorted, one of a single node is
dropped, two nodes are a pair at once, if length and positions still allow the threshold, and the rows of more nodes go
on. A pair is a candidate once it has been met by COMMON n-grams, which leaves out most pairs that met by chance.

Groups of thousands of near copies share many prefix n-grams; their pairs are not spelled out. First every node meets
the leaders of each of its n-grams: the smallest node, and in each of CENTRAL shares the node in whose prefix the n-gram
stands first. Such a node has few rare n-grams before it, so it is near the middle of its group: most others reach the
threshold with it, where two of them may not. What that joins gets a common label. Then only pairs of different labels
meet, and only where length and positions still allow the threshold: the longer side asks for the bands of lengths that
its position leaves open, so that the filters are part of the join key; and each row carries 512 parities of its set, of
which too many that differ rule a pair out where it would be made. A pair is verified once, whichever way it was found:
it first passes bit signatures, which bound the difference of the sets, then the suffix filter, then the count. Each set
is made again from its text where it is read and sent once for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import drop, keep, texts, word_key
from .words import NON_SPACE, U64, Words, join_hash, lists, mix, pieces, shingles

WORDS = 5
#: The threshold as a fraction.
OVER, UNDER = 3, 4
#: Counters for frequent n-grams; a table of this fixed size (one byte each) is broadcast.
COUNTERS, CHUNKS = 1 << 20, 16
#: Documents that have an n-gram among their first ones, above which it is put behind all rarer ones, and the most such
#: n-grams (9 bytes each) that are broadcast.
HOT, HOT_GRAMS = 16, 2_000_000
_BASE = U64((1 << 56) - 1)
#: N-grams that a pair must share in the prefixes (which are longer by one less than that). Different sets that reach the
#: threshold have at least two n-grams in common.
COMMON = 2
#: Pairs whose ids are broadcast at most to fetch the texts (about 40 bytes each); beyond, Spark deals both sides.
BROADCAST_PAIRS = 2_000_000
#: Row numbers that are broadcast at most (8 bytes each).
BROADCAST_ROWS = 4_000_000
#: Partners of a node that are verified in one place; a node with more is sent to several.
PARTNERS = 1024
BAND = math.log(1.05)
#: Leaders of an n-gram besides its smallest node: in each of so many shares of its nodes the one that has it first.
CENTRAL = 4


def frequent(docs: DataFrame, n: int = WORDS) -> np.ndarray:
    """A level for each counter: 0, or the rounded binary logarithm of how often its n-grams occur, if that is more than
    chance makes of n-grams that all occur alike. Every task sends its counters in chunks; they are summed before that is
    decided, so that an n-gram met a few times in each task counts as often as it occurs in all."""
    names, chunk, key = ["chunk", "counts"], COUNTERS // CHUNKS, word_key(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for b in pieces(batches):
            h, _ = shingles(Words(b.column(1), NON_SPACE, lower=True, key=key), n)
            total += np.bincount((h & U64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        kind = np.uint16 if total.max() < 1 << 16 else np.int64
        for i in range(CHUNKS) if total.any() else ():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i * chunk : (i + 1) * chunk].astype(kind).tobytes()])], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = sums.setdefault(i, np.zeros(chunk, np.int64))
                own += np.frombuffer(x, np.uint16 if len(x) == 2 * chunk else np.int64)
        for i, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([own.tobytes()])], names)

    counted = texts(docs).mapInArrow(count, "chunk int, counts binary").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    total = np.zeros(COUNTERS, np.int64)
    for i, x in zip(counted["chunk"].to_pylist(), counted["counts"].to_pylist(), strict=True):
        total[i * chunk : (i + 1) * chunk] = np.frombuffer(x, np.int64)
    mean = total.mean()
    often = total >= mean + 6 * math.sqrt(mean) + 4
    return np.where(often, np.log2(np.maximum(total, 1)), 0).astype(np.uint8)


@dataclass
class Order:
    """What is known of how often n-grams occur: a level for each counter, and levels of n-grams met often (sorted)."""

    level: np.ndarray
    hot: np.ndarray
    hot_level: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        """n-grams as numbers that ascend from rare to frequent: the level and the upper 56 bits of the hash."""
        base, level = h >> U64(8), self.level[(h & U64(COUNTERS - 1)).astype(np.int64)]
        if len(self.hot):
            i = np.minimum(np.searchsorted(self.hot, base), len(self.hot) - 1)
            level = np.where(self.hot[i] == base, np.maximum(level, self.hot_level[i]), level)
        return (level.astype(U64) << U64(56)) | base


def ordered_sets(array: pa.Array, order: Order | None, n: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, count per document): each document's distinct n-grams, in the global order if that is given."""
    h, doc = shingles(Words(array, NON_SPACE, lower=True, key=key), n)
    k = order.of(h) if order else h >> U64(8)
    ends = np.cumsum(np.bincount(doc, minlength=len(array)))
    for a, b in zip(ends - np.bincount(doc, minlength=len(array)), ends, strict=True):
        k[a:b].sort()
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])
    return k[new], np.bincount(doc[new], minlength=len(array))


def _prefix(k: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first n-grams of each set that a similar set must share some of, their number per set)."""
    first = np.where(size > 0, np.minimum(size, size - -(-OVER * size // UNDER) + COMMON), 0)
    at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size)
    return k[at < np.repeat(first, size)], first


def often_met(docs: DataFrame, level: np.ndarray, n: int) -> Order:
    """The order with those n-grams behind all others that more than HOT documents have in their first n-grams: counted
    one by one, where the counters only know sums. Of more than HOT_GRAMS the most frequent ones."""
    sent = docs.sparkSession.sparkContext.broadcast(Order(level, np.zeros(0, U64), np.zeros(0, np.uint8)))
    key = word_key(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            prefix, _ = _prefix(*ordered_sets(b.column(1), sent.value, n, key))
            yield pa.RecordBatch.from_arrays([pa.array((prefix & _BASE).view(np.int64))], ["g"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for b in batches:
            g = b.column(0).to_numpy()
            if not len(g):
                continue
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            size, own = np.diff(np.append(begin, len(g))), g[begin]
            if last is not None and own[0] == last:
                size[0] += held
            elif held > HOT:
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([held])], ["g", "c"])
            last, held = own[-1], int(size[-1])
            hot = size[:-1] > HOT
            yield pa.RecordBatch.from_arrays([pa.array(own[:-1][hot]), pa.array(size[:-1][hot])], ["g", "c"])
        if held > HOT:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([held])], ["g", "c"])

    grams = texts(docs).mapInArrow(cut, "g long").repartition("g").sortWithinPartitions("g")
    counted = keep(grams.mapInArrow(count, "g long, c long").withColumn("k", F.floor(F.log2(F.col("c").cast("double"))).cast("int")))
    levels = {r["k"]: r["n"] for r in counted.groupBy("k").agg(F.count("*").alias("n")).collect()}
    least = min(levels, default=0)
    while sum(x for k, x in levels.items() if k >= least) > HOT_GRAMS:
        least += 1
    hot = counted.where(F.col("k") >= least).select("g", "k").toArrow()
    drop(counted)
    g = hot["g"].to_numpy().view(U64)
    at = np.argsort(g)
    return Order(level, g[at], hot["k"].to_numpy()[at].astype(np.uint8))


def signature(m: np.ndarray) -> bytes:
    """The parities of how many values fall on each of about len(m) places; a power of two, so that it folds."""
    size = max(64, 1 << max(0, len(m) - 1).bit_length())
    return np.packbits((np.bincount((m & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


#: Columns of 64 parities each that rows carry where they meet, so that most pairs are ruled out before they are made.
PARITIES = 8


def parities(m: np.ndarray) -> list[int]:
    """signature() at PARITIES * 64 places, as signed numbers."""
    places = np.bincount((m & U64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(places.astype(np.uint8)).view(np.int64).tolist()


def _alike(x: str, y: str) -> Column:
    """Whether the parities of two rows leave the threshold open: the sets differ in one value at least for each parity."""
    differ = sum((F.bit_count(F.col(f"{x}.parities")[i].bitwiseXOR(F.col(f"{y}.parities")[i])) for i in range(PARITIES)), F.lit(0))
    both = F.col(f"{x}.n") + F.col(f"{y}.n")
    return differ <= both - 2 * F.ceil(OVER * both / (OVER + UNDER))


def least_difference(x: bytes, y: bytes) -> int:
    """Two sets differ in so many values at least: each differing parity needs one."""
    size = min(len(x), len(y))
    a, b = (np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), axis=0) for s in (x, y))
    return int(np.bitwise_count(a ^ b).sum())


def _made(docs: DataFrame, order: Broadcast, n: int) -> DataFrame:
    """row, doc_id, text_key (a hash of the text), n (set size), node (names the set, null if empty), prefix, sig (see
    signature), parities: stored."""
    names, key = ["row", "doc_id", "text_key", "n", "node", "prefix", "sig", "parities"], word_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            k, size = ordered_sets(b.column(1), order.value, n, key)
            ends = np.cumsum(size)
            node, m = _names(k & _BASE, size)
            prefix, first = _prefix(k, size)
            own = [m[z - c : z] for z, c in zip(ends, size, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(0), b.column(3), pa.array(size, pa.int32()), pa.array(node.view(np.int64), mask=size == 0), lists(prefix.view(np.int64), first, pa.int64()), pa.array(list(map(signature, own)), pa.binary()), pa.array(list(map(parities, own)), pa.list_(pa.int64()))], names)

    numbered = texts(docs).withColumns({"row": F.monotonically_increasing_id(), "text_key": F.xxhash64("text")})
    return keep(numbered.mapInArrow(run, "row long, doc_id long, text_key long, n int, node long, prefix array<long>, sig binary, parities array<long>"))


def _names(k: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a name of each set, from two sums over its n-grams and its size; the scrambled n-grams)."""
    bounds = np.concatenate([[0], np.cumsum(size)])
    total = lambda x: np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x)])[bounds])
    m = mix(k)
    return join_hash(join_hash(total(k), total(m)), size.astype(U64)), m


def _needed(a, b):
    """The least common n-grams of sets of a and b at the threshold."""
    return -(-OVER * (a + b) // (OVER + UNDER))


def _met(rows: DataFrame) -> DataFrame:
    """Of rows (g, node, n, pos): the pairs (a > b, met: by how many n-grams) of n-grams with two nodes, and the rows of
    n-grams with more as they are (node in a, b null). Dealt and sorted by g, so that a group is a run of rows; no more
    than two rows of a group are ever held."""
    names = ["g", "a", "b", "n", "pos"]

    def made(node, n, pos) -> pa.RecordBatch:
        """Pairs of each row of even number and the next."""
        fits = (UNDER * np.minimum(n[::2], n[1::2]) >= OVER * np.maximum(n[::2], n[1::2])) & (np.minimum(n[::2] - pos[::2], n[1::2] - pos[1::2]) > _needed(n[::2], n[1::2]) - COMMON)
        x, y = node[::2][fits], node[1::2][fits]
        pairs, met = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)]), axis=1, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.nulls(len(met), pa.int64()), pa.array(pairs[0]), pa.array(pairs[1]), pa.array(met.astype(np.int32)), pa.nulls(len(met), pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = None, None  # rows of the last group, and its g if it has shown to be a large one
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy() for c in b.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            g = cols[0]
            begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            sizes = np.diff(np.append(begin, len(g)))
            size = np.repeat(sizes, sizes)
            large = size > 2
            if passing is not None and g[0] == passing:
                large[: sizes[0]] = True
            whole = np.ones(len(g), bool)
            whole[begin[-1] :] = large[-1]
            passing = g[-1] if large[-1] else None
            held = None if large[-1] else [c[begin[-1] :] for c in cols]
            two = whole & ~large & (size == 2)
            yield made(*(c[two] for c in cols[1:]))
            rest = [c[whole & large] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), pa.nulls(len(rest[0]), pa.int64()), pa.array(rest[2]), pa.array(rest[3])], names)
        if held is not None and len(held[0]) == 2:
            yield made(*held[1:])

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(run, "g long, a long, b long, n int, pos int")


def _possible(x: str, y: str) -> Column:
    """The length filter, and the positional one: what is left from one of the first COMMON n-grams in common on must
    suffice on both sides."""
    nx, ny, px, py = (F.col(f"{s}.{c}") for c in ("n", "pos") for s in (x, y))
    need = F.ceil(OVER * (nx + ny) / (OVER + UNDER))
    return (UNDER * F.least(nx, ny) >= OVER * F.greatest(nx, ny)) & (F.least(nx - px, ny - py) > need - COMMON)


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At most so many common values of two sorted arrays, from the sizes of halves around middle values."""
    if not depth or min(len(x), len(y)) < 8:
        return min(len(x), len(y))
    mid = y[len(y) // 2]
    i = int(np.searchsorted(x, mid))
    hit = i < len(x) and x[i] == mid
    return suffix_bound(x[:i], y[: len(y) // 2], depth - 1) + int(hit) + suffix_bound(x[i + hit :], y[len(y) // 2 + 1 :], depth - 1)


def _plausible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (a, b) those whose signatures do not rule the threshold out, with the row (doc_id, text_key) that stands
    for each."""
    names = ["a", "b", "doc_a", "doc_b"]
    row = "struct<doc_id:bigint,text_key:bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = b.column(4).to_numpy().astype(np.int64) + b.column(5).to_numpy()
            most = both - 2 * _needed(both, 0)
            ok = pa.array([least_difference(x, y) <= d for x, y, d in zip(b.column(6).to_pylist(), b.column(7).to_pylist(), most, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(ok) for i in range(4)], names)

    x, y = (nodes.select(F.col("node").alias(c), F.struct("doc_id", "text_key").alias(f"doc_{c}"), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").select(*names, "n_a", "n_b", "sig_a", "sig_b")
    return both.mapInArrow(run, f"a long, b long, doc_a {row}, doc_b {row}")


def _packed(k: np.ndarray) -> bytes:
    """48 bits of each n-gram, in ascending order."""
    v = np.sort(k & U64((1 << 48) - 1))
    return v.astype("<u4").tobytes() + (v >> U64(32)).astype("<u2").tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    n = len(x) // 6
    return np.frombuffer(x, "<u4", n).astype(U64) | (np.frombuffer(x, "<u2", n, 4 * n).astype(U64) << U64(32))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Of pairs (a, b) those whose sets reach the threshold, stored. Only documents in a plausible pair are read for
    their sets. Of a pair, the set of the node with fewer partners goes to where the other one is."""
    plain = keep(_plausible(pairs, nodes))
    partners = plain.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("c"))
    counted = plain.join(partners.select(F.col("node").alias("a"), F.col("c").alias("c_a")), "a").join(partners.select(F.col("node").alias("b"), F.col("c").alias("c_b")), "b")
    turn = F.col("c_a") > F.col("c_b")
    either = lambda x, y, name: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name)
    counted = counted.select(either("a", "b", "a"), either("b", "a", "b"), either("doc_a", "doc_b", "doc_a"), either("doc_b", "doc_a", "doc_b"), F.floor(F.greatest("c_a", "c_b") / PARTNERS).cast("int").alias("places"))
    counted = keep(counted)
    place = F.pmod(F.xxhash64("a"), F.col("places") + 1).cast("int")
    goes = counted.select("doc_a.*", F.struct(F.col("a").alias("node"), F.col("b").alias("to"), place.alias("place")).alias("w"))
    stays = counted.select("doc_b", "b", "places").distinct().withColumn("place", F.explode(F.sequence(F.lit(0), F.col("places")))).select("doc_b.*", F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("to"), "place").alias("w"))
    wanted = keep(goes.union(stays).groupBy("doc_id", "text_key").agg(F.collect_list("w").alias("w")))
    if counted.count() <= BROADCAST_PAIRS:
        wanted = F.broadcast(wanted)
    rows = texts(docs).withColumn("text_key", F.xxhash64("text"))  # many rows may share a doc_id, or have none
    source = rows.alias("d").join(wanted.alias("w"), F.col("d.text_key").eqNullSafe(F.col("w.text_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.doc_id", "text", "w")
    names, key = ["at", "place", "a", "grams"], word_key(docs.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            k, size = ordered_sets(b.column(1), None, n, key)
            ends = np.cumsum(size)
            node = _names(k, size)[0].view(np.int64)
            rows: list[tuple] = []
            for i, want in enumerate(b.column(2).to_pylist()):
                own = [w for w in want if w["node"] == node[i]]  # texts of equal hash may be different
                grams = _packed(k[ends[i] - size[i] : ends[i]]) if own else b""
                rows += [(w["node"] if w["to"] is None else w["to"], w["place"], None if w["to"] is None else w["node"], grams) for w in own]
                if len(rows) * len(grams) > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, y = None, None
        for b in batches:
            linked = []
            for at, place, a, grams in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x = _unpacked(grams)
                if a is None:
                    key, y = (at, place), x
                    continue
                if key != (at, place):
                    raise RuntimeError("the set of a node has not come")
                need = _needed(len(x), len(y))
                if suffix_bound(x, y) >= need:
                    both = np.concatenate([x, y])
                    both.sort()
                    if (both[1:] == both[:-1]).sum() >= need:
                        linked.append((max(a, at), min(a, at)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in linked], pa.int64()) for i in range(2)], ["a", "b"])

    sent = source.mapInArrow(send, "at long, place int, a long, grams binary")
    dealt = sent.repartition("at", "place").sortWithinPartitions("at", "place", F.col("a").asc_nulls_first())
    links = keep(dealt.mapInArrow(check, "a long, b long").distinct())
    drop(plain, counted)
    return links


def _reach(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes with a link, stored."""
    return keep(components(edges).select(F.col("id").alias("node"), F.col("component_id").alias("label")))


def _mixed(many: DataFrame, own: DataFrame, reach: DataFrame) -> DataFrame:
    """Rows of many (g, node, n, pos) whose n-gram has nodes of several labels, with the label of each, the main one of the
    n-gram (that of most rows) and parities; stored."""
    labelled = own.select("node", "parities").join(reach, "node", "left").select("node", "parities", F.coalesce("label", "node").alias("label"))
    named = keep(many.join(labelled, "node"))
    counts = named.groupBy("g", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("g").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("g", "main")
    mixed = keep(named.join(main, "g"))
    drop(named)
    return mixed


def ngram_join(docs: DataFrame, n: int = WORDS, every_link: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles (distinct n-grams), component_id (smallest doc_id reachable by links),
    joining_links (links found of the document's class: enough of them to join all that is linked, not all that there
    are within a group of near copies), class_id (smallest doc_id of equal set). Two documents link if
    4 * common >= 3 * together.

    every_link: instead of joining_links a column links, the number of other sets that the document's set links with,
    none left out. The components are the same; a group of near copies then costs the square of its sets.

    Null, empty and blank texts have no n-gram and link with nothing; fewer words than n are one n-gram. Rows are told
    apart by their texts: rows that repeat a doc_id with different texts are compared each for itself. A row without
    doc_id takes part in links and gets the smallest doc_id it reaches, null if there is none. An empty table gives no
    rows; other columns are not looked at.
    """
    made = _made(docs, docs.sparkSession.sparkContext.broadcast(often_met(docs, frequent(docs, n), n)), n)

    # one row for each class of equal sets
    nodes = keep(made.where("n > 0").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("f")).select("node", F.col("f.doc_id").alias("doc_id"), F.col("f.row").alias("row")))
    reps = nodes.select("row")
    if reps.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    first = made.join(reps, "row", "left_semi")
    met = keep(_met(first.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "g")).select("g", "node", "n", "pos")))
    own = keep(first.select("node", "doc_id", "text_key", F.col("n").cast("int").alias("n"), "sig", "parities"))
    members = keep(made.select("doc_id", "n", "node"))
    drop(made)

    # pairs of n-grams with two nodes, and each node with the leaders of its other n-grams
    two = keep(met.where("b is not null").groupBy("a", "b").agg(F.sum("n").cast("int").alias("met")))
    many = met.where("b is null").select("g", F.col("a").alias("node"), "n", "pos")
    one, share = F.struct("node", "n", "pos"), F.pmod(F.xxhash64("node"), F.lit(CENTRAL))
    central = [F.min_by(one, F.when(share == i, F.struct("pos", "node"))) for i in range(CENTRAL)]
    lead = many.groupBy("g").agg(F.array_distinct(F.array_compact(F.array(F.min(one), *central))).alias("l")).select("g", F.inline("l"))
    star = many.alias("x").join(lead.alias("y"), "g").where("x.node <> y.node").where(_possible("x", "y"))
    star = star.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.lit(1).alias("met"))
    often = lambda pairs: pairs.groupBy("a", "b").agg(F.sum("met").alias("met")).where(F.col("met") >= COMMON).select("a", "b")
    # without leaders each node keeps a label of its own, so that no pair is left to what joins its nodes already
    asked = keep(often(two.union(star)).where(F.lit(not every_link)))
    edges = _verified(asked, own, docs, n)

    # pairs of different labels
    reach = _reach(edges)
    mixed = _mixed(many, own, reach)
    band = lambda c: F.floor(F.log(F.col(c).cast("double")) / BAND).cast("int")
    rem = F.col("n") - F.col("pos") + COMMON - 1
    longest = F.least(F.col("n").cast("long"), F.floor((OVER + UNDER) * rem / OVER).cast("long") - F.col("n"))
    shortest = F.ceil(OVER * F.col("n") / UNDER)
    asks = mixed.withColumns({"longest": longest, "shortest": shortest}).where("longest >= shortest").withColumn("band", F.explode(F.sequence(band("shortest"), band("longest")))).drop("longest", "shortest")
    has = mixed.withColumn("band", band("n"))

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        on = [F.col("x.g") == F.col("y.g"), F.col("x.band") == F.col("y.band"), F.col("x.label") != F.col("y.label"), F.struct("x.n", "x.node") > F.struct("y.n", "y.node"), _possible("x", "y"), _alike("x", "y")]
        return x.alias("x").join(y.alias("y"), on).select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b"), F.lit(1).alias("met"))

    other = pairs(asks.where("label <> main"), has).union(pairs(asks.where("label = main"), has.where("label <> main")))
    other = keep(often(other.union(two)).join(asked, ["a", "b"], "left_anti"))
    drop(met, two, mixed, asked)
    links = edges
    if not other.isEmpty():
        more = _verified(other, own, docs, n)
        links = edges.union(more)
        named = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(reach, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        side = lambda c: named.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
        between = components(more.join(side("a"), "a").join(side("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b")))
        reach = named.join(between.select(F.col("id").alias("label"), "component_id"), "label", "left").select("node", F.coalesce("component_id", "label").alias("label"))

    # from nodes back to documents
    reach = reach.select("node", F.col("label").alias("c"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    joined = keep(reach.join(degree, "node").join(own.select("node", "doc_id"), "node"))
    least = joined.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    joined = keep(joined.join(least, "c").select("node", "component_id", "links"))
    every = nodes.select("node", F.col("doc_id").alias("class_id")).join(joined, "node", "left")
    out = members.join(every, "node", "left")
    empty = F.col("n") == 0
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component_id", "class_id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links" if every_link else "joining_links"), F.when(empty, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
