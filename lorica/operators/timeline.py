"""Positions in recordings, and the alignment of text with them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of an Arrow batch of texts that goes to Python, where Spark's own bound is of 10,000 rows.
BATCH_BYTES = 4 << 20
LINE_ORDER = ("line", "p", "s", "t", "seconds")


def seek(recordings: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (article_id, target): the part that holds the target second, and the second within it. The target is
    clamped to the recording; a part's end belongs to the part; the last part takes what is left."""
    w = Window.partitionBy("article_id").orderBy(*LINE_ORDER)
    parts = recordings.withColumns({"part": F.row_number().over(w) - 1, "upto": F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    totals = recordings.groupBy("article_id").agg(F.sum("seconds").alias("total"))
    at = targets.join(totals, "article_id").select("article_id", F.greatest(F.lit(0), F.least("target", "total")).alias("at"), "total")
    # both on one axis, from its end: the last end of a part before a target is that of the part that holds it
    ends = parts.select("article_id", F.col("upto").alias("at"), F.lit(1).alias("kind"), F.struct("part", (F.col("upto") - F.col("seconds")).alias("begin")).alias("p"), F.lit(None).cast("long").alias("total"))
    asked = at.select("article_id", "at", F.lit(0).alias("kind"), F.lit(None).cast(ends.schema["p"].dataType).alias("p"), "total")
    axis = Window.partitionBy("article_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("p.part")).rowsBetween(Window.unboundedPreceding, 0)
    found = asked.unionByName(ends).withColumn("next", F.last("p", ignorenulls=True).over(axis)).where("kind = 0 and next is not null")
    return found.select("article_id", F.col("next.part").cast("long").alias("part"), (F.col("at") - F.col("next.begin")).alias("inside"), "total")


def elapsed(recordings: DataFrame) -> DataFrame:
    """Seconds of all earlier parts, for each part."""
    w = Window.partitionBy("article_id").orderBy(*LINE_ORDER)
    before = F.coalesce(F.sum("seconds").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return recordings.select("article_id", (F.row_number().over(w) - 1).alias("part"), "seconds", before.alias("before"))


def at_ratio(intervals: DataFrame, ratios: DataFrame, key: str = "article_id") -> DataFrame:
    """ratios (key, ratio): the interval that holds the ratio (start <= ratio < end), else the last one that starts in
    time. Intervals of a key follow each other, so either is the last one that starts in time; both are put on one axis."""
    starts = intervals.select(key, F.col("start").alias("ratio"), F.lit(0).alias("kind"), "ordinal", "type", "text")
    asked = ratios.select(key, "ratio", F.lit(1).alias("kind"), *(F.lit(None).cast(starts.schema[c].dataType).alias(c) for c in ("ordinal", "type", "text")))
    axis = Window.partitionBy(key).orderBy("ratio", "kind", "ordinal", "type", "text").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("last", F.last("ordinal", ignorenulls=True).over(axis)).where("kind = 1 and last is not null")
    return found.select(key, "ratio", F.col("last").alias("ordinal"))


def score_of(block: str, hint: str) -> int:
    """How well a block's text fits a hint: equal, one begins the other, a long beginning or the whole is contained. The
    numbers are fixed values."""
    if not block or not hint:
        return 0
    if block == hint:
        return 1000
    if block.startswith(hint) or hint.startswith(block):
        return 850 - min(200, abs(len(block) - len(hint)))
    if len(hint[:64]) >= 16 and hint[:64] in block:
        return 650
    a, b = sorted((block, hint), key=len)
    return 500 if len(a) >= 24 and a in b else 0


def aligned(entries: DataFrame, blocks: DataFrame, window: int = 14) -> DataFrame:
    """entries (article_id, ordinal, id, match, and perhaps at) find their block (article_id, pos, text), in order. An
    entry that says a place (at) which is there takes it. For the others a cursor moves on: the next ``window`` blocks
    are tried first, then all after the cursor, then all before. Articles pass one after the other, each with its blocks
    first; no more than one article's blocks and a batch are held."""

    def best(texts: list[str], hint: str, among: range, so_far: tuple[int, int]) -> tuple[int, int]:
        for i in among:
            s = score_of(texts[i], hint)
            if s > so_far[0]:
                so_far = (s, i)
            if s >= 900:
                break
        return so_far

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        article, texts, cursor = None, [], 0
        for b in batches:
            out: list[tuple] = []
            for key, entry, id_, text, said in zip(*(b.column(c).to_pylist() for c in ("article_id", "entry", "id", "text", "at")), strict=True):
                if key != article:
                    article, texts, cursor = key, [], 0
                if not entry:
                    texts.append(text)
                    continue
                if said is not None and 0 <= said < len(texts):
                    out.append((key, id_, said, None))
                    cursor = max(cursor, said + 1)
                    continue
                found = best(texts, text, range(cursor, min(len(texts), cursor + window)), (0, -1))
                for among in (range(cursor, len(texts)), range(min(cursor, len(texts)))):
                    if found[0] < 500:
                        found = best(texts, text, among, found)
                if found[0] >= 500:
                    out.append((key, id_, found[1], found[0]))
                    cursor = max(cursor, found[1] + 1) if found[1] >= cursor else cursor
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], ["article_id", "id", "block", "score"])

    entries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    article, none = F.col("article_id").cast("long").alias("article_id"), F.lit(None)
    said = F.col("at") if "at" in entries.columns else none
    first = blocks.select(article, F.lit(False).alias("entry"), F.col("pos").cast("long").alias("place"), none.cast("string").alias("id"), "text", none.cast("long").alias("at"))
    then = entries.select(article, F.lit(True).alias("entry"), F.col("ordinal").cast("long").alias("place"), "id", F.col("match").alias("text"), said.cast("long").alias("at"))
    dealt = first.union(then).repartition("article_id").sortWithinPartitions("article_id", "entry", "place", "id")
    return dealt.mapInArrow(align, "article_id long, id string, block int, score int")
