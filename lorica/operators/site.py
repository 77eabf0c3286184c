"""Pages of a site: routes with what they show, documents made of many rows, and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from .ranking import numbered


def routes(posts: DataFrame, categories: DataFrame, least_series: int = 2) -> DataFrame:
    """(path, kind, props): one page for each article, category, series and tag, props as JSON that may stand in a page.
    Tags and series without enough articles have a page too, marked noindex."""
    path = lambda folder, c: F.concat(F.lit(f"/{folder}/"), c, F.lit("/")).alias("path")
    page = lambda kind, props: (F.lit(kind).alias("kind"), nested.escaped_json(F.struct(*props)).alias("props"))
    articles = posts.select(path("posts", F.col("id").cast("string")), *page("article", ["id", "title", F.col("category_slug").alias("category")]))
    count = lambda df, k: df.groupBy(k).agg(F.count("*").alias("articles"))
    by_category = categories.join(count(posts, "category_slug"), F.col("slug") == F.col("category_slug"), "left")
    by_category = by_category.select(path("category", F.col("slug")), *page("category", ["slug", F.coalesce("articles", F.lit(0)).alias("articles")]))
    noindex = lambda least: (F.col("articles") < least).alias("noindex")
    series = count(posts.where("series_slug is not null"), "series_slug").select(path("series", F.col("series_slug")), *page("series", [F.col("series_slug").alias("slug"), "articles", noindex(least_series)]))
    tags = count(posts.select("id", F.explode(F.array_distinct("tags")).alias("tag")), "tag").select(path("tags", text.encode_component(F.col("tag"))), *page("tag", ["tag", "articles", noindex(3)]))
    return articles.unionByName(by_category).unionByName(series).unionByName(tags)


def with_tag(posts: DataFrame, tag: str) -> DataFrame:
    return posts.where(F.array_contains("tags", tag))


def faceted(posts: DataFrame, facet: str) -> DataFrame:
    """Articles of a category; 'all' is every one."""
    return posts if facet == "all" else posts.where(F.col("category_slug") == facet)


def in_list(posts: DataFrame, saved: DataFrame) -> DataFrame:
    """Articles on a reader's list."""
    return posts.join(saved.select("id").distinct(), "id", "left_semi")


def navigation(paths: Column, current: Column) -> Column:
    """Which of the entries is that of the current page: its own, or one that it lies below (the home page only itself)."""
    return F.filter(paths, lambda p: F.when(p == "/", current == "/").otherwise(current.startswith(p)))


def thumbnail(post_thumbnail: Column, image: Column, category_image: Column) -> Column:
    """A card's picture: its own thumbnail, the article's picture, the category's."""
    return F.coalesce(post_thumbnail, image, category_image)


def level_two(body: Column) -> Column:
    """The headings of level 2, for a table of contents."""
    return F.regexp_extract_all(body, F.lit(r"(?m)^##[ \t]+(.+?)[ \t]*$"), F.lit(1))


def share_url(base: str, path: Column) -> Column:
    """An address as a value in another one: decoded first, so that nothing is encoded twice."""
    return text.encode_component(F.concat(F.lit(base), nested.decoded(path)))


def schema_json(posts: DataFrame, base: str) -> DataFrame:
    """(id, json): the structured data of each article."""
    url = F.concat(F.lit(f"{base}/posts/"), F.col("id").cast("string"), F.lit("/"))
    changed = F.coalesce("updated_at", "published_at")
    value = F.struct(
        F.col("title").alias("headline"), numbers.iso_ms(F.col("published_at")).alias("datePublished"), numbers.iso_ms(changed).alias("dateModified"),
        url.alias("mainEntityOfPage"), F.col("category_slug").alias("articleSection"), F.array_join("tags", ", ").alias("keywords"))
    return posts.select("id", nested.escaped_json(value).alias("json"))


def _document(rows: DataFrame, order: list[Column], head: str, tail: str) -> DataFrame:
    """One document of the lines of all rows. Only for documents that one reader takes whole: a feed of the newest
    articles, or one of the sitemaps that part() has cut."""
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), "line"))).alias("l"))
    return lines.select(F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(tail)).alias("document"))


def rss_document(items: DataFrame, title: str, most: int = 50) -> DataFrame:
    """items (id, title, link, pub_date, published_at): a feed of the newest, titles escaped already."""
    newest = items.orderBy(F.desc("published_at"), "id").limit(most)
    tag = lambda n, c: F.concat(F.lit(f"<{n}>"), c, F.lit(f"</{n}>"))
    line = F.concat(F.lit("<item>"), tag("title", F.col("title")), tag("link", F.col("link")), tag("pubDate", F.col("pub_date")), F.lit("</item>"))
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{title}</title>'
    return _document(newest.withColumn("line", line), [-F.unix_micros("published_at"), F.col("id")], head, "</channel></rss>")


#: Addresses that one sitemap may hold. Fixed value.
SITEMAP_URLS = 50_000


def sitemap_documents(urls: DataFrame, base: str, most: int = SITEMAP_URLS) -> DataFrame:
    """(part, document): urls (path, lastmod) in sitemaps of ``most`` addresses each, the last one of what is left, in the
    order of their paths."""
    entry = F.concat(F.lit("<url><loc>"), text.escape_xml(F.concat(F.lit(base), F.col("path"))), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.col("lastmod"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    rows = numbered(urls.select("path", entry.alias("line")), "path", "line").select(F.floor((F.col("rank") - 1) / most).alias("part"), F.struct("path", "line").alias("l"))
    grouped = rows.groupBy("part").agg(F.array_sort(F.collect_list("l")).alias("l"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', "</urlset>"
    return grouped.select("part", F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit(tail)).alias("document"))


def picture_plan(files: DataFrame, widths: tuple[int, ...] = (320, 640, 960, 1280)) -> DataFrame:
    """(file, width, height, target): the derived pictures of each cover, 16 to 9."""
    made = files.select("file", F.explode(F.array(*map(F.lit, widths))).alias("width"))
    return made.select("file", "width", numbers.half_up(F.col("width") * 9 / 16).cast("int").alias("height"), F.concat(text.base_name(F.col("file")), F.lit("-"), F.col("width").cast("string"), F.lit(".webp")).alias("target"))
