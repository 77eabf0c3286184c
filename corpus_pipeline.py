"""The corpus pipeline: toxicity, exact dedup, near dedup, benchmark decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorica.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from lorica.llm.queries import tokenizer_path
from lorica.llm.store import drop, keep, stage, table

#: Ids that are broadcast at most to drop their rows (16 bytes each); beyond, Spark deals both sides by doc_id.
BROADCAST_IDS = 4_000_000


def _distinct_ids(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id is null or n > 1").isEmpty()


def without(docs: DataFrame, gone: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """docs without the rows whose doc_id gone(docs) lists. Where ids repeat or are missing, the rows are first numbered
    in the order of doc_id (null last) and text, stored, and decided on by these numbers, so that each row stands for
    itself and of equal rows one is the first."""
    names, rows, given = docs.columns, docs, F.col("doc_id")
    if not _distinct_ids(docs):
        own = "_" * (1 + max(map(len, names)))  # a name that no column has
        order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
        dealt = docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(own, F.col("doc_id"))
        rows, given = keep(dealt.withColumn("doc_id", F.monotonically_increasing_id())), F.col(own)
    ids = keep(gone(rows).select("doc_id").distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", "left_anti").withColumn("doc_id", given).select(names)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model, learned from the labelled documents outside the held-out fold, calls toxic go. Null and empty
    texts stay, as do all rows where nothing is labelled; an empty table stays empty. Every column is handed on."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return without(docs, lambda rows: toxicity.score(rows, model).where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows of equal text (white space aside; null is empty) the one of the smallest doc_id stays; among rows that
    repeat that doc_id one stays, and a row without doc_id only if no other has its text."""
    return without(docs, lambda rows: exact_dedup.exact_dedup(rows).where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by similar sets of 5 words the smallest doc_id stays. Rows without words are in no group."""
    return without(docs, lambda rows: ngram_join.ngram_join(rows).where("doc_id <> component_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold ten consecutive words of a benchmark item, or all of a shorter item, go. Null texts hold nothing."""
    return without(docs, lambda rows: decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows left, each packed for itself, null texts as the end id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, decide in STAGES[:-1]:
        with stage(spark):  # what the stage has kept for itself goes as soon as its result is written
            docs = keep(decide(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizer and learned scores have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None
