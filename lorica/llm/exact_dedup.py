"""Exact dedup through a distributed minimal perfect hash.

The distinct digests of a history are dealt to shards by their leading bits. For each shard a minimal perfect hash is
built (hash and displace: one seed per bucket), whose slots hold the full digest, the locator of the winner and the
number of rows. The index is a table: one row per bucket (seed) and one per slot. A lookup is two joins, so that a
digest which a third of all rows share is only a skewed join side, which Spark splits. The digest in the slot is
compared byte by byte; rows whose digest is not in the history are grouped among themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep, texts

#: Mean number of digests in a shard; each shard is built in one task.
SHARD_DIGESTS = 20_000
BUCKET_DIGESTS = 2.5

_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def normalised(column: str = "text"):
    return F.regexp_replace(F.col(column), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each whole text after each run of white space became one space; null is empty."""
    return texts(docs).select("doc_id", F.unhex(F.sha2(normalised(), 256)).alias("digest"))


def _with_seed(h: np.ndarray, seed: int) -> np.ndarray:
    """What Spark's xxhash64(digest, seed) gives, from h = xxhash64(digest)."""
    u = np.uint64
    x = (h + _P5 + u(4)) ^ u(seed * int(_P1) & (2**64 - 1))
    x = ((x << u(23)) | (x >> u(41))) * _P2 + _P3
    x = (x ^ (x >> u(33))) * _P2
    x = (x ^ (x >> u(29))) * _P3
    return x ^ (x >> u(32))


def perfect_hash(h: np.ndarray, bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed of each bucket, slot of each key), slots being 0 to len(h) - 1 once each. A seed below 0 is slot -seed-1."""
    m = len(h)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    seeds, slots, used = np.zeros(buckets, np.int32), np.zeros(m, np.int64), np.zeros(m, bool)
    for size in range(int(sizes.max(initial=0)), 1, -1):  # large buckets first; all of a size try a seed together
        left, seed = np.flatnonzero(sizes == size), 0
        while len(left):
            seed += 1
            keys = order[starts[left][:, None] + np.arange(size)]
            s = (_with_seed(h[keys], seed).view(np.int64) % m).astype(np.int64)
            first = np.zeros(s.size, bool)
            first[np.unique(s, return_index=True)[1]] = True
            ok = first.reshape(s.shape).all(1) & ~used[s].any(1)
            used[s[ok]] = True
            seeds[left[ok]], slots[keys[ok]] = seed, s[ok]
            left = left[~ok]
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~used)
    slots[order[starts[single]]], seeds[single] = free, -free - 1
    return seeds, slots


def _place(df: DataFrame, shards: int, buckets: int) -> DataFrame:
    """Adds shard and bucket, from different bits of the digest."""
    part = lambda at: F.conv(F.hex(F.substring("digest", at, 4)), 16, 10).cast("long")
    return df.withColumns({"shard": (part(1) % shards).cast("int"), "bucket": (part(5) % buckets).cast("int")})


class HistoryIndex:
    """Seeds and slots as tables, and how digests are placed."""

    def __init__(self, history: DataFrame):
        """history: (digest, winner, n), one row per digest."""
        history = keep(history)
        shards = max(1, -(-history.count() // SHARD_DIGESTS))
        buckets = int(SHARD_DIGESTS / BUCKET_DIGESTS)
        self.shards, self.buckets = shards, buckets

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            seeds, slots = perfect_hash(pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["bucket"].to_numpy(), buckets)
            pdf = pdf.assign(slot=slots).sort_values("slot")
            slot = [{"digest": d, "winner": w, "n": n} for d, w, n in zip(pdf["digest"], pdf["winner"].astype(object).where(pdf["winner"].notna(), None), pdf["n"], strict=True)]
            return pd.DataFrame([(pdf["shard"].iloc[0], len(pdf), seeds, slot)], columns=["shard", "m", "seeds", "slots"])

        built = keep(
            _place(history, shards, buckets)
            .withColumn("h", F.xxhash64("digest"))
            .groupBy("shard")
            .applyInPandas(build, "shard int, m int, seeds array<int>, slots array<struct<digest:binary,winner:long,n:long>>")
        )
        self.seeds = built.select("shard", "m", F.posexplode("seeds").alias("bucket", "seed")).where("seed != 0")
        self.slots = built.select("shard", F.posexplode("slots").alias("slot", "s")).select("shard", "slot", F.col("s.digest").alias("slot_digest"), "s.winner", "s.n")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, digest) with winner and n of the slot that holds the same digest, null for nonmembers."""
        slot = F.when(F.col("seed") < 0, -F.col("seed") - 1).otherwise(F.pmod(F.xxhash64("digest", "seed"), F.col("m"))).cast("int")
        at = _place(rows, self.shards, self.buckets).join(self.seeds, ["shard", "bucket"], "left").withColumn("slot", slot)
        found = at.join(self.slots, ["shard", "slot"], "left")
        same = F.col("digest") == F.col("slot_digest")
        return found.select("doc_id", "digest", F.when(same, F.col("winner")).alias("winner"), F.when(same, F.col("n")).alias("n"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min("doc_id").alias("winner"), F.count("*").alias("n"))


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row per row of docs: doc_id, digest, keep_id, group_size, kept, in_history.

    history: earlier documents. A row whose digest is in the history is a repeat of the history's smallest doc_id and
    goes; other rows are grouped among themselves. Without history the distinct digests of docs themselves are the
    history, whose winners stay. Null texts count as empty; rows that repeat doc_id and text get equal answers, so all
    rows with the smallest doc_id of their text stay. An empty table gives no rows.
    """
    rows = keep(digests(docs))
    if history is None:
        found = HistoryIndex(distinct_digests(rows)).lookup(rows)
        return found.select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lit(False).alias("in_history"))
    found = keep(HistoryIndex(distinct_digests(digests(history))).lookup(rows))
    own = found.where("n is null").select("doc_id", "digest")
    first = distinct_digests(own).withColumnRenamed("digest", "d")
    new = own.join(first, own["digest"] == first["d"]).select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("winner")).alias("kept"), F.lit(False).alias("in_history"))
    old = found.where("n is not null").select("doc_id", "digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"), F.lit(False).alias("kept"), F.lit(True).alias("in_history"))
    return new.unionByName(old)
