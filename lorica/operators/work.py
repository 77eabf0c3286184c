"""What is still to be done, at what price, and from which source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audit import bounded


#: The language in which ids are put in order. Fixed value.
LANGUAGE = "ar"


def missing(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of wanted (article_id, source_hash, ...) that the cache does not hold complete."""
    return wanted.join(cache.where("complete").select("article_id", "source_hash"), ["article_id", "source_hash"], "left_anti")


def next_work(missing_: DataFrame, cap: int) -> DataFrame:
    """The shortest jobs first, equal ones by id, so many as the cap allows. Ids that are texts follow the rules of the
    language, not their bytes."""
    text = missing_.schema["article_id"].dataType.typeName() == "string"
    return missing_.orderBy("requests", F.collate("article_id", LANGUAGE) if text else "article_id", "article_id").limit(cap)


def totals(missing_: DataFrame, voices: int = 1) -> DataFrame:
    return missing_.agg(F.count("*").alias("articles"), F.coalesce(F.sum("characters") * voices, F.lit(0)).alias("characters"), F.coalesce(F.sum("requests") * voices, F.lit(0)).alias("requests"))


def by_priority(sources: DataFrame, priorities: DataFrame) -> DataFrame:
    """sources (article_id, provider, complete): for each article the complete source of the best priority, null if
    there is none."""
    ranked = sources.join(bounded(priorities), "provider")
    return ranked.groupBy("article_id").agg(F.min_by("provider", F.when(F.col("complete"), F.col("priority"))).alias("provider"), F.max("complete").alias("ok")).select("article_id", F.when(F.col("ok"), F.col("provider")).alias("provider"))


def latest_runs(ledger: DataFrame, n: int = 100) -> DataFrame:
    """The read view of an append-only ledger: its last n runs."""
    return ledger.orderBy(F.desc("seq")).limit(n)


def merged_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of (article_id, body_hash, checks): rows of new replace those of old with the same id."""
    return old.join(new.select("article_id"), "article_id", "left_anti").unionByName(new)


def kept_checks(rules: DataFrame, posts: DataFrame) -> DataFrame:
    """Checks whose phrase the body still has, under the body's new hash."""
    both = rules.join(posts.select(F.col("id").alias("article_id"), "body"), "article_id")
    return both.select("article_id", F.sha2("body", 256).alias("body_hash"), F.filter("checks", lambda c: F.contains(F.col("body"), c["from"])).alias("checks"))


def changed_only(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of after that are new or differ."""
    b = before.select(F.col(key).alias("_k"), F.struct(*before.columns).alias("_b"))
    joined = after.join(b, after[key] == b["_k"], "left")
    return joined.where(~F.struct(*(after[c] for c in after.columns)).eqNullSafe(F.col("_b"))).select(*(after[c] for c in after.columns))


def positional_gaps(expected: DataFrame, found: DataFrame, tolerance: float) -> DataFrame:
    """Parts that differ: (article_id, pos, seconds) on both sides, at the same place, within a tolerance."""
    f = found.select("article_id", "pos", F.col("seconds").alias("found"))
    both = expected.join(f, ["article_id", "pos"], "full_outer")
    return both.where(F.col("seconds").isNull() | F.col("found").isNull() | (F.abs(F.col("seconds") - F.col("found")) > tolerance))


def in_list_order(lists: DataFrame, items: DataFrame) -> DataFrame:
    """lists (list_id, ids) spelled out in order; missing shows ids that items does not have."""
    spelled = lists.select("list_id", F.posexplode("ids").alias("pos", "id"))
    return spelled.join(items.withColumn("_there", F.lit(True)), "id", "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def incomplete(candidates: DataFrame, cases: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of candidate and case that are not done."""
    return candidates.crossJoin(bounded(cases)).join(done, ["candidate", "case_id"], "left_anti")


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    return left.join(right, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "only_right").otherwise("only_left").alias("side"))


def unique_provider(parts: DataFrame) -> DataFrame:
    """The first provider named in each article, and whether all its parts agree."""
    return parts.groupBy("article_id").agg(F.min_by("provider", F.when(F.col("provider") != "", F.col("pos"))).alias("provider"), (F.countDistinct(F.when(F.col("provider") != "", F.col("provider"))) <= 1).alias("consistent"))


def with_missing_rules(rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """rules (article_id, from, to) and those of wanted whose article and phrase have none yet."""
    return rules.unionByName(wanted.join(rules, ["article_id", "from"], "left_anti"))


def all_rules(common: Column, own: Column) -> Column:
    """The rules for all articles, then those of one: arrays, either may be null."""
    kind = "array<struct<from:string,to:string>>"
    return F.concat(F.coalesce(common, F.array().cast(kind)), F.coalesce(own, F.array().cast(kind)))


def found_or_error(rows: DataFrame, key: str, value: object) -> DataFrame:
    """The rows of one key; an error when they are asked for and there is none."""
    one = rows.where(F.col(key) == F.lit(value))
    none = rows.sparkSession.range(1).join(one.select(F.lit(True).alias("_there")).limit(1), F.lit(True), "left")
    said = F.raise_error(F.lit(f"no row with {key} = {value}")).cast("boolean")
    failed = none.where(F.when(F.col("_there").isNull(), said).otherwise(F.lit(False)))
    return one.unionByName(failed.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema)))


def exactly(ids: DataFrame, key: str, count: int) -> DataFrame:
    """One row: distinct ids, rows, and whether there are so many, each once."""
    return ids.agg(F.countDistinct(key).alias("distinct_ids"), F.count("*").alias("n")).withColumn("ok", (F.col("distinct_ids") == count) & (F.col("n") == count))
