"""One query for each operator family, over the tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import numbers, python_udfs, text
from ..operators import audit, feed, lab, ranking, routing, search, speech, timeline, work
from ..sources import tables as T
from ..streaming import state

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _published(spark: SparkSession, d: str) -> DataFrame:
    return feed.published(T.posts(spark, d))


@query
def published_feed(spark, d):
    return _published(spark, d).select("id", "category_slug", numbers.iso_ms(F.col("published_at")).alias("published"), "featured")


@query
def latest_20(spark, d):
    return feed.feed(_published(spark, d).select("id", "published_at"), 20).select("id")


@query
def latest_per_category_top3(spark, d):
    return feed.top_per_category(_published(spark, d), T.categories(spark, d))


@query
def category_lastmod_with_empty(spark, d):
    return feed.category_last_change(_published(spark, d), T.categories(spark, d))


@query
def tag_index_counts(spark, d):
    return feed.tag_counts(_published(spark, d))


@query
def tag_index_threshold(spark, d):
    return ranking.numbered(feed.tag_counts(_published(spark, d).where("featured"), 3), F.collate("tag", "ar"), "tag", name="place")


@query
def series_counts(spark, d):
    return feed.series_counts(_published(spark, d))


@query
def series_ordered(spark, d):
    p = _published(spark, d)
    order = spark.createDataFrame([("src1", 41, 1), ("src1", 1, 2), ("src2", 22, 1)], "series_slug string, id long, place int")
    return feed.series_entries(p, order)


@query
def signature_or_latest(spark, d):
    chosen = spark.createDataFrame([("en", 5), ("de", -1), ("fr", 6)], "category_slug string, id long")
    return feed.signature(_published(spark, d), chosen)


@query
def related_top3(spark, d):
    return feed.related(_published(spark, d))


@query
def prev_next(spark, d):
    return feed.neighbours(_published(spark, d))


@query
def home_slots(spark, d):
    return feed.home_slots(_published(spark, d), "de")


@query
def sitemap_urls(spark, d):
    return feed.sitemap(_published(spark, d), T.categories(spark, d))


@query
def rss_items(spark, d):
    return feed.rss_items(_published(spark, d), "https://example.org")


@query
def reading_minutes(spark, d):
    words = text.word_count(F.col("body"))
    return _published(spark, d).select("id", words.alias("words")).withColumn("minutes", text.reading_minutes(F.col("words")))


@query
def search_excerpt(spark, d):
    return _published(spark, d).select("id", text.excerpt(F.col("body")).alias("excerpt"))


@query
def search_contains(spark, d):
    return search.search(search.index(_published(spark, d)), "the ")


@query
def search_ascii(spark, d):
    p = _published(spark, d)
    return p.where(F.contains(F.lower("title"), F.lit("the"))).select("id")


@query
def link_integrity(spark, d):
    return audit.broken_links(T.table(spark, d, "pages"))


@query
def duplicate_titles(spark, d):
    return audit.duplicate_titles(T.table(spark, d, "pages"))


@query
def redirect_routing(spark, d):
    rules = spark.createDataFrame([(0, "/old", "/new", 301), (1, "/p/*", "/pages/", 302), (2, "/*", "/404", 404)], "ord int, from string, to string, status int")
    return routing.redirected(T.table(spark, d, "pages").select(audit.page_path(F.col("url")).alias("path")).distinct(), rules)


@query
def segment_text(spark, d):
    return speech.speech_segments(_published(spark, d)).select("id", "segment_id", "type", "match")


@query
def chunk_text(spark, d):
    return speech.chunked(T.segments(spark, d), 120)


@query
def pack_parts(spark, d):
    return speech.packed(speech.chunked(T.segments(spark, d), 120), 400)


@query
def pack_numeric(spark, d):
    return speech.packed_sizes(T.segments(spark, d), 400)


@query
def sync_intervals(spark, d):
    return speech.sync_intervals(T.segments(spark, d))


@query
def sync_merge_islands(spark, d):
    return speech.merged_runs(speech.sync_intervals(T.segments(spark, d)))


@query
def seek_to_part(spark, d):
    r = T.recordings(spark, d)
    return timeline.seek(r, r.select("article_id").distinct().withColumn("target", F.col("article_id") % 97))


@query
def elapsed_before(spark, d):
    return timeline.elapsed(T.recordings(spark, d))


@query
def sync_lookup(spark, d):
    s = T.segments(spark, d)
    ratios = s.select("article_id").distinct().withColumn("ratio", (F.col("article_id") * 37 % 100 * 10000).cast("long"))
    return timeline.at_ratio(speech.sync_intervals(s), ratios)


@query
def text_alignment(spark, d):
    s = T.segments(spark, d)
    form = python_udfs.match_form(F.col("text"))
    w = Window.partitionBy("article_id").orderBy(*speech.IN_ORDER)
    blocks = s.select("article_id", (F.row_number().over(w) - 1).alias("pos"), form.alias("text"))
    entries = s.select("article_id", "ordinal", F.concat_ws("-", "ordinal", "type", F.substring(F.md5("text"), 1, 8)).alias("id"), F.left(form, F.lit(120)).alias("match")).where("match <> ''")
    return timeline.aligned(entries, blocks)


def _sources(spark, d):
    s = T.segments(spark, d).groupBy("article_id").agg(F.count("*").alias("n"))
    providers = spark.createDataFrame([("cache", 1, 2), ("first", 2, 3), ("second", 3, 5)], "provider string, priority int, m int")
    return s.crossJoin(F.broadcast(providers)).select("article_id", "provider", "priority", (F.col("article_id") % F.col("m") == 0).alias("complete")), providers.select("provider", "priority")


@query
def provider_fallback(spark, d):
    sources, priorities = _sources(spark, d)
    return work.by_priority(sources.drop("priority"), priorities)


def _wanted(spark, d):
    s = T.segments(spark, d).groupBy("article_id").agg(F.count("*").alias("requests"), F.sum(F.char_length("text")).alias("characters"))
    return s.withColumn("source_hash", F.sha2(F.col("article_id").cast("string"), 256))


@query
def missing_work_plan(spark, d):
    w = _wanted(spark, d)
    cache = w.where("article_id % 3 = 0").select("article_id", "source_hash", (F.col("article_id") % 2 == 0).alias("complete"))
    return work.next_work(work.missing(w, cache), 25).select("article_id", "requests", "characters")


@query
def missing_work_totals(spark, d):
    w = _wanted(spark, d)
    return work.totals(work.missing(w, w.where("article_id % 4 = 0").withColumn("complete", F.lit(True))), 2)


@query
def cost_plan(spark, d):
    w = _wanted(spark, d)
    p = spark.createDataFrame([("character",), ("token_25",), ("token_50",), ("rated",)], "provider string")
    each = w.crossJoin(F.broadcast(p)).withColumn("usd", numbers.cost_usd(F.col("provider"), F.col("characters")))
    out = each.groupBy("provider").agg(F.round(numbers.total_or_null(F.col("usd")), 4).alias("usd"), F.sum("characters").alias("characters"))
    return out.withColumn("gate", numbers.gate(F.col("characters"), 20_000, 200_000)).withColumn("reached", numbers.threshold_reached(F.col("characters") / 400_000.0, [0.7, 0.85, 0.95]))


@query
def content_fingerprint(spark, d):
    return _published(spark, d).select("id", numbers.audio_key(F.col("id")).alias("audio_key"), F.sha2("body", 256).alias("body_hash"))


@query
def lab_ranking(spark, d):
    r = T.ratings(spark, d)
    winners = T.table(spark, d, "orders").select((F.col("o_orderkey") % 100 + 1).alias("candidate"))
    return lab.ranking(r, winners)


@query
def lab_criteria(spark, d):
    means = lab.criterion_means(T.ratings(spark, d), [0, 1, 2, 3, 4])
    return means.select("candidate", *(F.col(str(i)).alias(f"c{i}") for i in range(5)))


@query
def lab_completion(spark, d):
    return lab.completion(T.ratings(spark, d).select(F.col("score").between(1, 5).alias("done")))


@query
def lab_shuffle(spark, d):
    cases = spark.createDataFrame([(i,) for i in range(1, 7)], "case_id int")
    return lab.shuffled(T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("candidate")), cases, "seed-1")


@query
def review_leaks(spark, d):
    return audit.leaks(T.table(spark, d, "documents"), T.table(spark, d, "benchmark"))


@query
def article_schema_failures(spark, d):
    return audit.schema_failures(T.posts(spark, d))


@query
def latest_progress(spark, d):
    e = T.reader_events(spark, d)
    return state.latest(e.where("event_type = 'view'"), ["user_id"], "value").select("user_id", F.round("value", 4).alias("value"), numbers.iso_ms(F.col("ts")).alias("ts"))


@query
def unexpired_progress(spark, d):
    e = T.reader_events(spark, d)
    now = e.agg(F.max("ts").alias("now"))
    s = state.latest(e.where("event_type = 'view'"), ["user_id"], "value").crossJoin(F.broadcast(now))
    return state.unexpired(s, F.col("now"), 1).select("user_id")


@query
def reading_list_state(spark, d):
    e = T.reader_events(spark, d).where("event_type = 'click'").withColumn("item", F.floor(F.col("value")).cast("long") % 10)
    return state.toggled(e, ["user_id", "item"])


@query
def read_depth_once(spark, d):
    e = T.reader_events(spark, d)
    return state.first_crossing(e.where("event_type = 'view'"), "user_id", 75.0).select("user_id", "event_id")


@query
def engaged_once(spark, d):
    return state.engaged(T.reader_events(spark, d), "user_id", 5, 60).select("user_id", "event_id")


@query
def consented_events(spark, d):
    e = T.reader_events(spark, d)
    consents = e.where("event_type in ('signup', 'error')").select("user_id", "ts", (F.col("event_type") == "signup").alias("granted"))
    return state.consented(e.where("event_type in ('view', 'click')"), consents, "user_id")


@query
def throttled_saves(spark, d):
    return state.throttled(T.reader_events(spark, d).where("event_type = 'view'"), "user_id", 3600.0)


@query
def numbered_customers(spark, d):
    c = T.table(spark, d, "customer")
    return ranking.numbered(c.select("c_custkey", "c_acctbal"), F.desc("c_acctbal"), F.asc("c_custkey")).select("c_custkey", "rank")
