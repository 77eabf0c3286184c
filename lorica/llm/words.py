"""Words of whole Arrow batches as numpy arrays: borders and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_K1, _K2, _BASE = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x100000001B3 * 0x9E37 | 1)

#: Bytes that belong to words split at ASCII white space.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of ASCII letters and digits and of all characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U64(32))) * _K1
    x = (x ^ (x >> U64(29))) * _K2
    return x ^ (x >> U64(32))


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two hash arrays."""
    return mix(a * _K1 + b + U64(0x51))


#: Bytes of a span that are hashed in blocks; longer spans are rare and get a digest each.
LONG = 256
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of data on, as one number (zeros after the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span. The blocks of 8 bytes enter one after the other, each scrambled together
    with the length and all blocks before; spans of up to 8 bytes and equal length never collide."""
    lens, eights = end - start, _eights(data)
    out = mix(lens.astype(U64) * _K2 + _BASE)
    live, at = np.flatnonzero((lens > 0) & (lens <= LONG)), 0
    while len(live):
        left = lens[live] - at
        out[live] = mix(out[live] ^ (eights[start[live] + at] & _MASKS[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(lens > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@functools.lru_cache(maxsize=8)
def _multipliers(key: int) -> np.ndarray:
    """Two rows of random 64-bit numbers: for the length, and for each 4 bytes."""
    return np.random.Generator(np.random.PCG64(key)).integers(0, 1 << 64, (2, 1 + LONG // 4), U64)


def keyed_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int) -> np.ndarray:
    """64-bit hash of the bytes of each span under a secret key. Each half is a sum of the length and of all blocks of 4
    bytes, each times a random number, of which the upper 32 bits count (multiply-shift hashing): whatever two
    different spans are, they collide for one key in 2**64, and nobody without the key can make two that do."""
    lens, eights, half = end - start, _eights(data), U64(0xFFFFFFFF)
    sums = [m[0] * lens.astype(U64) for m in _multipliers(key)]
    live, at = np.flatnonzero((lens > 0) & (lens <= LONG)), 0
    while len(live):
        left = lens[live] - at
        block = eights[start[live] + at] & _MASKS[np.minimum(left, 8)]
        low, high = block & half, block >> U64(32)
        for total, m in zip(sums, _multipliers(key), strict=True):
            total[live] += m[1 + at // 4] * low + m[2 + at // 4] * high
        live, at = live[left > 8], at + 8
    out = mix((sums[0] & ~half) | (sums[1] >> U64(32)))
    for i in np.flatnonzero(lens > LONG):
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
    return out


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each distinct content, for each span the index of its content). Spans of equal hash are compared byte
    by byte, so that contents are never mixed up."""
    _, at, content = np.unique(h, return_index=True, return_inverse=True)
    lens, other, eights = end - start, at[content], _eights(data)
    same = lens == lens[other]
    live, k = np.flatnonzero(same & (other != np.arange(len(other))) & (lens > 0)), 0
    while len(live) and k < LONG:
        left = lens[live] - k
        ok = ((eights[start[live] + k] ^ eights[start[other[live]] + k]) & _MASKS[np.minimum(left, 8)]) == 0
        same[live[~ok]] = False
        live, k = live[ok & (left > 8)], k + 8
    for i in live:
        j = other[i]
        same[i] = data[start[i] : end[i]].tobytes() == data[start[j] : end[j]].tobytes()
    if not same.all():
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(~same):
            content[i] = more.setdefault(data[start[i] : end[i]].tobytes(), len(at) + len(more))
        first = {int(content[i]): i for i in np.flatnonzero(~same)[::-1]}
        at = np.append(at, [first[k] for k in sorted(first)]).astype(np.int64)
    return at, content


class Words:
    """Words of the texts in one Arrow array.

    data: the bytes (lower-cased if asked); start, end: borders in data; hash: 64 bits, under a key if there is one;
    first: for each document the index of its first word, with the total as last entry.
    """

    def __init__(self, array: pa.Array, word_bytes: np.ndarray, lower: bool = False, key: int | None = None):
        array = array.cast(pa.large_string())
        if array.null_count:
            array = array.fill_null("")
        n = len(array)
        _, offsets, data = array.buffers()
        offs = np.frombuffer(offsets, np.int64)[array.offset : array.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.offsets = offs - offs[0]
        self.data = LOWER[raw] if lower else raw
        word = word_bytes[raw]
        size = len(raw)
        edge = np.zeros(size + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(size, bool)
        before[1:] = word[:-1]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        after = np.zeros(size, bool)
        after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = span_hashes(self.data, self.start, self.end) if key is None else keyed_hashes(self.data, self.start, self.end, key)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document's index in the array, for each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of n words; a document of fewer words has its whole sequence as one."""
    counts, h = words.counts(), words.hash
    grams = np.maximum(counts - n + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), grams)
    ends = np.cumsum(grams)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - grams, grams) + words.first[:-1][doc]
    last = words.first[1:][doc]
    out = np.full(len(at), 7, U64)
    for k in range(n):
        i = at + k
        ok = i < last
        out = np.where(ok, join_hash(out, h[np.minimum(i, max(len(h) - 1, 0))]) if len(h) else out, out)
    return out, doc


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values (borders are the caller's), by doubling."""
    if len(h) < n:
        return np.zeros(0, U64)
    total = len(h) - n + 1
    out, at, block, size = None, 0, h, 1
    while n >> (size.bit_length() - 1):
        if n & size:
            part = block[at : at + total]
            out = part if out is None else join_hash(out, part)
            at += size
        if len(block) > size:
            block = join_hash(block[:-size], block[size:])
        size *= 2
        if size > n:
            break
    return out


def give_back() -> None:
    """Freed memory goes back to the system: Python workers outlive their tasks, and what one stage has used must not
    stay beside the next one's. Only glibc has malloc_trim."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, one document at least."""
    give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + batch.num_rows + 1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array with counts[i] of the values for row i."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
