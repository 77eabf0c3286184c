"""The feed of published articles and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from .audit import bounded
from .ranking import numbered, numbered_within

FEED_ORDER = (F.desc, "published_at"), (F.asc, "id")


def _newest() -> list[Column]:
    return [F.desc("published_at"), F.asc("id")]


def published(posts: DataFrame, drafts: bool = False) -> DataFrame:
    """Articles that are no drafts (drafts=True: all, as in development)."""
    return posts if drafts else posts.where(~F.coalesce("draft", F.lit(False)))


def feed(posts: DataFrame, most: int | None = None) -> DataFrame:
    """Newest first; equal times by id."""
    ordered = posts.orderBy(*_newest())
    return ordered if most is None else ordered.limit(most)


def top_per_category(posts: DataFrame, categories: DataFrame, n: int = 3) -> DataFrame:
    """Every category with its number of articles and the ids of its n newest, empty categories too."""
    newest = posts.withColumn("rn", F.row_number().over(Window.partitionBy("category_slug").orderBy(*_newest()))).where(F.col("rn") <= n)
    ids = newest.groupBy("category_slug").agg(F.array_sort(F.collect_list(F.struct("rn", "id"))).alias("top"))
    count = posts.groupBy("category_slug").agg(F.count("*").alias("n"))
    out = categories.join(count.withColumnRenamed("category_slug", "slug"), "slug", "left").join(ids.withColumnRenamed("category_slug", "slug"), "slug", "left")
    return out.select("slug", F.coalesce("n", F.lit(0)).alias("articles"), F.coalesce(F.array_join(F.transform("top", lambda x: x["id"].cast("string")), ","), F.lit("")).alias("newest"))


def changed_at() -> Column:
    return F.coalesce("updated_at", "published_at")


def category_last_change(posts: DataFrame, categories: DataFrame) -> DataFrame:
    """The latest change in each category, null where there is none."""
    last = posts.groupBy(F.col("category_slug").alias("slug")).agg(F.max(changed_at()).alias("t"))
    return categories.join(last, "slug", "left").select("slug", F.date_format("t", "yyyy-MM-dd").alias("lastmod"))


def tag_counts(posts: DataFrame, least: int = 1) -> DataFrame:
    """Articles of each tag (an article counts once) from ``least`` on."""
    return posts.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("articles")).where(F.col("articles") >= least)


def series_counts(posts: DataFrame, least: int = 2) -> DataFrame:
    return posts.where("series_slug is not null").groupBy("series_slug").agg(F.count("*").alias("articles")).where(F.col("articles") >= least)


def with_series(posts: DataFrame, series: DataFrame) -> DataFrame:
    """posts with what the short list of series (slug, title, description) says of theirs, null if nothing."""
    meta = bounded(series).select(F.col("slug").alias("series_slug"), F.struct("title", "description").alias("series"))
    return posts.join(meta, "series_slug", "left")


def series_entries(posts: DataFrame, order: DataFrame) -> DataFrame:
    """Articles of each series: those with a place in ``order`` (series_slug, id, place) first, then the oldest."""
    rows = posts.where("series_slug is not null").join(order, ["series_slug", "id"], "left").select("series_slug", "id", "place", "published_at")
    return numbered_within(rows, "series_slug", F.col("place").asc_nulls_last(), "published_at", "id", name="position").select("series_slug", "id", "position")


def signature(posts: DataFrame, chosen: DataFrame) -> DataFrame:
    """For each (category_slug, id) of chosen: that article, whatever its category, if it is published, else the newest
    of the category."""
    newest = posts.groupBy("category_slug").agg(F.max_by("id", F.struct("published_at", -F.col("id"))).alias("newest"))
    there = posts.select(F.col("id").alias("found"))
    return chosen.join(there, chosen["id"] == there["found"], "left").join(newest, "category_slug", "left").select("category_slug", F.coalesce("found", "newest").alias("id"))


def neighbours(posts: DataFrame) -> DataFrame:
    """The next newer and next older article of each."""
    r = numbered(posts.select("id", "published_at"), *_newest()).select("id", "rank")
    newer, older = r.select(F.col("id").alias("newer"), (F.col("rank") + 1).alias("rank")), r.select(F.col("id").alias("older"), (F.col("rank") - 1).alias("rank"))
    return r.join(newer, "rank", "left").join(older, "rank", "left").select("id", "newer", "older")


def home_slots(posts: DataFrame, books: str) -> DataFrame:
    """The home page: the newest article, the newest other one of the books category, the next three, six and three
    (the last three only if there are three)."""
    first = posts.select("id", "category_slug", "published_at").orderBy(*_newest()).limit(14)
    w = Window.orderBy(*_newest())  # over 14 rows
    ranked = first.withColumn("rn", F.row_number().over(w))
    hero = ranked.where("rn = 1").select("id", F.lit("hero").alias("slot"), F.lit(1).alias("position"))
    book = posts.where(F.col("category_slug") == books).join(hero.select("id"), "id", "left_anti").orderBy(*_newest()).limit(1).select("id", F.lit("book").alias("slot"), F.lit(1).alias("position"))
    taken = hero.union(book)
    rest = first.join(F.broadcast(taken.select("id")), "id", "left_anti").withColumn("k", F.row_number().over(w))
    slot = F.when(F.col("k") <= 3, "side").when(F.col("k") <= 9, "latest").when(F.col("k") <= 12, "picks")
    start = F.when(F.col("k") <= 3, 0).when(F.col("k") <= 9, 3).otherwise(9)
    rest = rest.select("id", slot.alias("slot"), (F.col("k") - start).cast("int").alias("position")).where("slot is not null")
    whole = rest.withColumn("n", F.count("*").over(Window.partitionBy("slot"))).where("slot <> 'picks' or n = 3").drop("n")
    return taken.unionByName(whole)


def _tag_sets(tags: Column) -> Column:
    """Every choice from an article's tags (two at most), a doubled tag once and twice, as text."""
    one, two = F.get(tags, F.lit(0)), F.get(tags, F.lit(1))
    single, double = lambda t: F.concat(t, F.lit("\x01")), lambda t: F.concat(t, F.lit("\x02"))
    both = F.concat(single(F.least(one, two)), single(F.greatest(one, two)))
    pair = F.when(one == two, F.array(F.lit(""), single(one), double(one))).otherwise(F.array(F.lit(""), single(one), single(two), both))
    many = F.raise_error(F.lit("an article has two tags at most")).cast("array<string>")
    return F.when(F.coalesce(F.size(tags), F.lit(0)) <= 0, F.array(F.lit(""))).when(F.size(tags) == 1, F.array(F.lit(""), single(one))).when(F.size(tags) == 2, pair).otherwise(many)


def _asked_sets(tags: Column) -> Column:
    """Every choice of tags that another article may share with these: as above, and each tag twice."""
    twice = F.transform(F.array_distinct(F.coalesce(tags, F.array().cast("array<string>"))), lambda t: F.concat(t, F.lit("\x02")))
    return F.array_distinct(F.concat(_tag_sets(tags), twice, F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.concat(t, F.lit("\x01")))))


def _keys(sets: Column, series: Column, category: Column) -> Column:
    """All combinations of a choice of tags, the series or none, the category or none; tags or the series are in each."""
    option = lambda c, name: F.filter(F.array(F.lit(""), F.concat(F.lit(name), c)), lambda x: x.isNotNull())
    made = F.flatten(F.transform(sets, lambda t: F.flatten(F.transform(option(series, "s:"), lambda s: F.transform(option(category, "c:"), lambda c: F.struct(t.alias("t"), s.alias("s"), c.alias("c")))))))
    return F.filter(made, lambda k: (k["t"] != "") | (k["s"] != ""))


def related(posts: DataFrame, n: int = 3) -> DataFrame:
    """The n most related articles of each: by series (8), shared tags (3 each; a tag counts as often as the candidate
    has it) and category (1), then the newest of the category, then the newest of all.

    What two articles share is one of few combinations of tags (two at most), series and category. An article is among
    the first n only if it is among the newest n + 1 of those that have all it shares: all others of these score at least
    as much. So each combination hands on its newest n + 1 articles, whatever number has it, and an article asks for the
    combinations of its own; articles alike in all three ask once.
    """
    p = posts.select("id", "category_slug", "series_slug", "tags", "published_at")
    kind = ["category_slug", "series_slug", "tags"]
    a = p.select(*kind).distinct().select(*(F.col(c).alias(f"a_{c}") for c in kind))
    by_class = [F.col(f"a_{c}") for c in kind]
    has = p.withColumn("k", F.explode(_keys(_tag_sets(F.col("tags")), F.col("series_slug"), F.col("category_slug"))))
    newest_of_key = has.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*_newest()))).where(F.col("rn") <= n + 1).drop("rn")
    asks = a.withColumn("k", F.explode(_keys(_asked_sets(F.col("a_tags")), F.col("a_series_slug"), F.col("a_category_slug"))))
    shared = F.size(F.filter("tags", lambda t: F.array_contains("a_tags", t)))
    same = F.coalesce(F.col("a_series_slug") == F.col("series_slug"), F.lit(False))
    score = F.when(same, 8).otherwise(0) + shared * 3 + F.coalesce(F.col("a_category_slug") == F.col("category_slug"), F.lit(False)).cast("int")
    best = asks.join(newest_of_key, "k").select(*by_class, F.col("id").alias("candidate"), score.alias("score"), "published_at", F.lit(1).alias("tier"))
    local = p.withColumn("rn", F.row_number().over(Window.partitionBy("category_slug").orderBy(*_newest()))).where(F.col("rn") <= n + 1)
    # up to 2n + 1 of a category and of all: n may already stand higher
    in_category = a.join(local, F.col("a_category_slug") == F.col("category_slug")).select(*by_class, F.col("id").alias("candidate"), F.lit(0).alias("score"), "published_at", F.lit(2).alias("tier"))
    newest = p.orderBy(*_newest()).limit(2 * n + 1)
    anywhere = a.crossJoin(F.broadcast(newest)).select(*by_class, F.col("id").alias("candidate"), F.lit(0).alias("score"), "published_at", F.lit(3).alias("tier"))
    every = best.unionByName(in_category).unionByName(anywhere)
    once = every.groupBy(*(f"a_{c}" for c in kind), "candidate").agg(F.min(F.struct("tier", (-F.col("score")).alias("less"), "published_at")).alias("x"))
    once = once.select(*by_class, "candidate", "x.tier", (-F.col("x.less")).alias("score"), "x.published_at")
    place = Window.partitionBy(*by_class).orderBy("tier", F.desc("score"), F.desc("published_at"), "candidate")
    few = once.withColumn("rn", F.row_number().over(place)).where(F.col("rn") <= n + 1).select(*by_class, "candidate", "rn")
    own = p.select("id", *kind)
    same_class = [own[c].eqNullSafe(few[f"a_{c}"]) for c in kind]
    out = own.join(few, same_class).where("id <> candidate").select("id", "candidate", "rn")
    return out.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("rn"))).where(F.col("position") <= n).select("id", "candidate", "position")


def sitemap(posts: DataFrame, categories: DataFrame, least_series: int = 2, least_tag: int = 3) -> DataFrame:
    """(path, lastmod) of all pages: fixed ones, categories (null date if empty), series and tags with enough articles,
    articles."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("lastmod")
    fixed = posts.agg(F.max(changed_at()).alias("t")).select(F.explode(F.array(*map(F.lit, ("/", "/articles/", "/start-here/", "/series/")))).alias("path"), day("t"))
    by_category = category_last_change(posts, categories).select(F.concat(F.lit("/category/"), "slug", F.lit("/")).alias("path"), "lastmod")
    s = posts.where("series_slug is not null").groupBy("series_slug").agg(F.count("*").alias("n"), F.max(changed_at()).alias("t")).where(F.col("n") >= least_series)
    t = posts.select(F.explode(F.array_distinct("tags")).alias("tag"), changed_at().alias("c")).groupBy("tag").agg(F.count("*").alias("n"), F.max("c").alias("t")).where(F.col("n") >= least_tag)
    return (
        fixed.unionByName(by_category)
        .unionByName(s.select(F.concat(F.lit("/series/"), "series_slug", F.lit("/")).alias("path"), day("t")))
        .unionByName(t.select(F.concat(F.lit("/tags/"), text.encode_component(F.col("tag")), F.lit("/")).alias("path"), day("t")))
        .unionByName(posts.select(F.concat(F.lit("/posts/"), F.col("id").cast("string"), F.lit("/")).alias("path"), day(changed_at())))
    )


def rss_items(posts: DataFrame, base: str) -> DataFrame:
    link = F.concat(F.lit(f"{base}/posts/"), F.col("id").cast("string"), F.lit("/"))
    return posts.select("id", text.escape_xml(F.col("title")).alias("title"), link.alias("link"), numbers.rfc1123(F.col("published_at")).alias("pub_date"), F.col("category_slug").alias("category"))
