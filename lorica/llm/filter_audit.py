"""How filters of a corpus act on each other, in every order in which they may be applied.

A document is a mask: one bit for each filter that it fails. Documents of one mask behave alike in every order, so they
are counted first; the cells (part, mask) are then unpivoted against the steps of all orders. A running bit-or over the
steps before says whether an earlier filter has removed the cell; conditional sums give what each step keeps and removes,
and totals over all orders what a filter is to blame for.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import keep

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest (of the text), mask (bits A to D): too few words, too many repeated ones, too many capital
    letters, a mark. All of these depend on the text alone."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")
    t = t.select("doc_id", "part", "text", words.alias("words"))
    t = t.select("doc_id", "part", "text", F.size("words").cast("long").alias("n"), F.size(F.array_distinct("words")).cast("long").alias("distinct"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    fails = [
        F.col("n") < LEAST_WORDS,
        100 * F.col("distinct") < DISTINCT_PERCENT * F.col("n"),
        100 * capitals > CAPITAL_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails)), F.lit(0))
    return t.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and how many of them are labelled good or toxic.

    Bit E: a smaller doc_id of the whole table has the same text. Null and empty texts are the same text; a null lang is
    the part of the empty string. Rows that repeat a doc_id count each for itself; with one text they are no copies of
    each other. A row without doc_id has no label, is no copy and makes none. Of labels that repeat a doc_id any may say
    good or toxic; null labels say neither. An empty table has no cells; other columns are not looked at.
    """
    key = ["doc_id", "digest", "part", "mask"]
    counted = keep(text_failures(docs).groupBy(*key).agg(F.count("*").alias("n")))
    named = counted.where("doc_id is not null")
    # the row that stays meets its group by digest and id, so that a group of many copies is in many places
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    copy = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    marked = named.join(first, ["digest", "doc_id"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n").join(said, "doc_id", "left")
    times = lambda c: F.when(F.col(c), F.col("n")).otherwise(0)
    rows = marked.select("part", "mask", "n", times("good").alias("good"), times("toxic").alias("toxic"))
    nameless = counted.where("doc_id is null").select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return rows.union(nameless).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def interactions(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Of cells (part, mask, n, good, toxic): part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley for every order of the filters (letters, by ascending bit). Every part has all steps."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    letter = F.expr("substring(filter_order, step, 1)")
    long = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    long = long.withColumn("filter", letter).withColumn("bit", F.expr(f"shiftleft(1, instr('{filters}', filter) - 1)"))
    own = F.col("mask").bitwiseAND(F.col("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or(own).over(before), F.lit(0)))
    fails, still = own != 0, F.col("earlier") == 0

    def total(condition: Column, of: str, name: str) -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).cast("long").alias(name)

    steps = long.groupBy("part", "filter_order", "step", "filter").agg(
        total(still & ~fails, "n", "kept"), total(still & fails, "n", "removed"), total(~still & fails, "n", "redundant"),
        total(F.col("mask") == F.col("bit"), "n", "unique_fails"), total(still & fails, "good", "good_lost"), total(still & fails, "toxic", "toxic_lost"))
    over = Window.partitionBy("part", "filter")
    return steps.withColumn("shapley", F.sum("removed").over(over)).drop("filter")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the five filters over all documents."""
    return interactions(cells(docs, labels))
