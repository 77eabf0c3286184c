"""Blind evaluation: drawing of orders, scores, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import bounded
from .ranking import numbered, numbered_within


def shuffled(candidates: DataFrame, cases: DataFrame, seed: str) -> DataFrame:
    """For each case an order of the candidates that only the seed decides."""
    pairs = candidates.crossJoin(bounded(cases))
    key = F.sha2(F.concat_ws(":", F.lit(seed), F.col("case_id").cast("string"), F.col("candidate").cast("string")), 256)
    return numbered_within(pairs.withColumn("key", key), "case_id", "key", "candidate", name="place").select("case_id", "candidate", "place")


def ranking(ratings: DataFrame, winners: DataFrame) -> DataFrame:
    """For each candidate the mean of its valid scores (1 to 5; in thousandths), how many cases have one, its wins,
    and its place: by mean (none counts below all), wins, id."""
    valid = F.col("score").between(1, 5)
    s = ratings.groupBy("candidate").agg(F.sum(F.when(valid, F.col("score"))).alias("total"), F.count(F.when(valid, True)).alias("scores"), F.countDistinct(F.when(valid, F.col("case_id"))).alias("cases"))
    w = winners.groupBy("candidate").agg(F.count("*").alias("wins"))
    mean = F.when(F.col("scores") > 0, F.floor((F.col("total") * 2000 + F.col("scores")) / (F.col("scores") * 2))).cast("long")
    out = s.join(w, "candidate", "left").select("candidate", mean.alias("mean_milli"), "cases", F.coalesce("wins", F.lit(0)).alias("wins"))
    return numbered(out, F.coalesce("mean_milli", F.lit(-1)).desc(), F.desc("wins"), F.asc("candidate"), name="place")


def criterion_means(ratings: DataFrame, criteria: list[int]) -> DataFrame:
    valid = ratings.where(F.col("score").between(1, 5))
    return valid.groupBy("candidate").pivot("criterion", criteria).agg(F.round(F.avg("score"), 3))


def completion(done: DataFrame) -> DataFrame:
    """Percent of rows that are done, halves upwards, 0 of none."""
    n, d = F.count("*"), F.count(F.when(F.col("done"), True))
    return done.agg(d.alias("complete"), n.alias("total"), F.when(n == 0, 0).otherwise(F.floor((d * 200 + n) / (n * 2))).cast("long").alias("percent"))


def revealed(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """ratings (case_id, code, ...) with the candidate that the key (case_id, code, candidate) names; others are dropped."""
    return ratings.join(key, ["case_id", "code"])


def enabled(candidates: DataFrame) -> DataFrame:
    """Candidates that are not switched off."""
    return candidates.where(F.coalesce("enabled", F.lit(True)))


def canonical(cases: DataFrame, segments: DataFrame) -> DataFrame:
    """cases (case_id, article_id, segment_id) with the text of their segment (article_id, segment_id, text), and in how
    many segments of that name it was found: 0 is a case without one, and more than 1 are no name."""
    named = segments.groupBy("article_id", "segment_id").agg(F.min("text").alias("text"), F.count("*").alias("segments"))
    return cases.join(named, ["article_id", "segment_id"], "left").withColumn("segments", F.coalesce("segments", F.lit(0)))


#: Seconds that a clip may last. Fixed values.
SHORTEST, LONGEST = 2, 90


def integrity(candidates: DataFrame, cases: DataFrame, segments: DataFrame, items: DataFrame) -> DataFrame:
    """(candidate, case_id, rule, n) of everything that keeps a blind evaluation from being sound: cases whose segment is
    missing or not unique (candidate null); items (candidate, case_id, text, text_sha256, seconds) of an unknown case or
    candidate, doubled ones, ones made from another text than the canonical one (text or digest must agree) or of a length
    outside the limits; and candidates that do not have all cases (case_id null, n: how many they lack).

    Completeness is a division: the distinct known cases of each candidate are counted against the number of all cases,
    and no pair that is missing is ever spelled out."""
    named = canonical(cases, segments)
    row = lambda df, rule, candidate, case, n: df.select(candidate.alias("candidate"), case.alias("case_id"), F.lit(rule).alias("rule"), n.cast("long").alias("n"))
    no_candidate, no_case = (F.lit(None).cast(df.schema[c].dataType) for df, c in ((candidates, "candidate"), (cases, "case_id")))
    candidate, case, one = F.col("candidate"), F.col("case_id"), F.lit(1)

    known = items.join(named, "case_id", "left_semi").join(candidates, "candidate", "left_semi")
    counted = known.groupBy("candidate", "case_id").agg(F.count("*").alias("n"))
    have = counted.groupBy("candidate").agg(F.count("*").alias("have"))
    total = cases.agg(F.countDistinct("case_id").alias("total"))
    lacking = candidates.select("candidate").distinct().join(have, "candidate", "left").crossJoin(F.broadcast(total)).withColumn("n", F.col("total") - F.coalesce("have", F.lit(0)))

    said = items.withColumnsRenamed({"text": "said", "text_sha256": "said_sha256"}).join(named, "case_id")
    same = F.coalesce(F.col("said") == F.col("text"), F.lit(False)) | F.coalesce(F.col("said_sha256") == F.sha2("text", 256), F.lit(False))
    length = F.coalesce(F.col("seconds").between(SHORTEST, LONGEST), F.lit(False))
    return reduce(DataFrame.unionByName, [
        row(named.where("segments = 0"), "no_segment", no_candidate, case, one),
        row(named.where("segments > 1"), "segment_not_unique", no_candidate, case, F.col("segments")),
        row(items.join(cases, "case_id", "left_anti"), "unknown_case", candidate, case, one),
        row(items.join(candidates, "candidate", "left_anti"), "unknown_candidate", candidate, case, one),
        row(counted.where("n > 1"), "doubled", candidate, case, F.col("n")),
        row(lacking.where("n > 0"), "incomplete", candidate, no_case, F.col("n")),
        row(said.where((F.col("segments") > 0) & ~same), "other_text", candidate, case, one),
        row(items.where(~length), "length", candidate, case, one),
    ])
