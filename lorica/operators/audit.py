"""Audits: what is wrong, as rows (subject, rule, detail)."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from ahocorasick import Automaton
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import nested, numbers, text


def found_all(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target): all values of href and src, and the addresses of every srcset, whose widths are left out."""
    single = found_all(F.col("html"), r"""\b(?:href|src|data-src)=["']([^"']+)["']""")
    sets = found_all(F.col("html"), r"""\bsrcset=["']([^"']+)["']""")
    each = F.flatten(F.transform(sets, lambda s: F.transform(F.split(s, ","), lambda p: F.element_at(F.split(F.trim(p), r"\s+"), 1))))
    return pages.select("page_id", F.explode(F.concat(single, each)).alias("target")).where("target <> ''")


def file_path(file: Column) -> Column:
    """The path under which a generated file is a page: an index file is its folder, the ending goes."""
    inner = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(file, r"/index\.html$", "/"), r"\.html$", ""))
    return F.when(file == "index.html", "/").otherwise(inner)


def page_path(url: Column) -> Column:
    """The path of a page's address, as links name it: without query, fragment and file ending."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]+", ""), r"[?#].*$", "")
    return F.when(path == "", "/").otherwise(F.regexp_replace(F.regexp_replace(path, r"/index\.html$", "/"), r"\.html$", ""))


def broken_links(pages: DataFrame) -> DataFrame:
    """Internal links (one slash at the start) to no page: exact, with .html, or with /index.html."""
    there = pages.select(page_path(F.col("url")).alias("path")).distinct()
    wanted = links(pages).where(F.col("target").startswith("/") & ~F.col("target").startswith("//")).distinct()
    clean = F.regexp_replace(F.col("target"), r"[?#].*$", "")
    tries = wanted.withColumn("path", F.explode(F.array_distinct(F.array(page_path(clean), F.concat(page_path(clean), F.lit("/"))))))
    good = tries.join(there, "path", "left_semi").select("page_id", "target").distinct()
    return wanted.join(good, ["page_id", "target"], "left_anti")


def _meta(html: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(html, rf"""(?i)<meta\s+name=["']{name}["']\s+content=["']([^"']*)["']""", 1))


def canonical(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?i)<link\s+rel=["']canonical["']\s+href=["']([^"']+)["']""", 1)


def noindex(html: Column) -> Column:
    return _meta(html, "robots").rlike(r"(?i)\bnoindex\b")


def page_title(html: Column) -> Column:
    return text.plain_html(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))


def page_rules(now: Column | None = None) -> dict[str, Column]:
    """What each rule on a single page finds (column html): null if the page keeps it. The patterns are fixed formats."""
    h = F.col("html")
    tags = lambda pattern, lacks: F.size(F.filter(found_all(h, pattern, 0), lambda t: ~t.rlike(lacks)))
    some = lambda n: F.when(n > 0, n)
    h1 = F.size(found_all(h, r"(?i)<(h1)\b"))
    ids = found_all(h, r"""(?i)\bid=["']([^"']+)["']""")
    named = found_all(h, r"""(?i)\baria-controls=["']([^"']+)["']""")
    images = r"(?i)<img\b[^>]*>"
    main = F.coalesce(F.nullif(F.regexp_extract(h, r"(?is)<main\b[^>]*>(.*?)</main>", 1), F.lit("")), h)
    levels = F.transform(found_all(main, r"(?i)<h([1-6])\b"), lambda x: x.cast("int"))
    steps = F.zip_with(F.slice(levels, F.lit(2), F.greatest(F.size(levels) - 1, F.lit(0))), F.slice(levels, F.lit(1), F.greatest(F.size(levels) - 1, F.lit(0))), lambda b, a: F.when(b > a + 1, a * 10 + b))
    title, description = page_title(h), _meta(h, "description")
    scripts = F.zip_with(found_all(h, r"(?is)<script\b([^>]*)>(.*?)</script>", 1), found_all(h, r"(?is)<script\b([^>]*)>(.*?)</script>", 2), lambda a, b: ~a.rlike(r"(?i)\bsrc=") & ~a.rlike(r"""(?i)type=["'](?:application/ld\+json|application/json)["']""") & (F.trim(b) != ""))
    cards = F.transform(found_all(h, r"""(?is)<a\b[^>]*class=["'][^"']*post-card-media[^"']*["'][^>]*>(.*?)</a>"""), lambda c: F.regexp_extract(c, images, 0))
    side = lambda c, n: F.nullif(F.regexp_extract(c, rf"""(?i)\b{n}=["'](\d+)["']""", 1), F.lit("")).cast("long")
    indexed = ~noindex(h)
    changed = F.try_to_timestamp(F.nullif(F.regexp_extract(h, r"""(?i)<meta\s+property=["']article:modified_time["']\s+content=["']([^"']+)["']""", 1), F.lit("")))
    rules = {
        "h1": F.when(h1 != 1, h1),
        "duplicate_ids": some(F.size(ids) - F.size(F.array_distinct(ids))),
        "button_type": some(tags(r"(?i)<button\b[^>]*>", r"""(?i)\btype=["'](?:button|submit|reset)["']""")),
        "aria_controls": some(F.size(F.array_except(named, ids))),
        "image_alt": some(tags(images, r"""(?i)\balt=["'][^"']*["']""")),
        "image_size": some(tags(images, r"""(?is)^(?=.*\bwidth=["']\d+["'])(?=.*\bheight=["']\d+["'])""")),
        "inline_style": some(F.size(found_all(h, r"""(?i)\s(style)=["'][^"']*["']"""))),
        "card_thumbnail": some(F.size(F.filter(cards, lambda c: (c != "") & ~c.rlike(r"""(?i)\bsrc=["']/images/thumbnails/""")))),
        "card_shape": some(F.size(F.filter(cards, lambda c: (c != "") & ~F.coalesce(nested.wide(side(c, "width"), side(c, "height")), F.lit(False))))),
        "priority": F.nullif(F.greatest(F.size(found_all(h, r"""(?i)<img\b[^>]*\bfetchpriority=["']high["'][^>]*>""", 0)), F.lit(1)), F.lit(1)),
        "empty_link": some(F.size(found_all(h, r"""(?i)\b(?:href|src)=["'](#?)["']"""))),
        "heading_jump": F.try_element_at(F.array_compact(steps), F.lit(1)),
        "no_title": F.when(title == "", 1),
        "no_description": F.when(description == "", 1),
        "no_canonical": F.when(canonical(h) == "", 1),
        "long_title": F.when(indexed & (F.char_length(title) > 70), F.char_length(title)),
        "description_length": F.when(indexed & (description != "") & ~F.char_length(description).between(70, 160), F.char_length(description)),
        "inline_script": some(F.size(F.filter(scripts, lambda s: s))),
    }
    return rules if now is None else rules | {"future": F.when(nested.in_future(changed, now), 1)}


def page_failures(pages: DataFrame, now: Column | None = None) -> DataFrame:
    """(page_id, rule, detail) of rules on single pages; detail is a count or a length, for heading_jump both levels.
    now: also asks whether a page says that it was changed in the future."""
    spread = pages.select("page_id", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), d.cast("long").alias("detail")) for r, d in page_rules(now).items()))).alias("x"))
    return spread.select("page_id", "x.rule", "x.detail").where("detail is not null")


def article_failures(pages: DataFrame) -> DataFrame:
    """(page_id, rule) on pages of articles: a source outside, a link within the site, a named author, no address that
    was encoded twice."""
    body = F.regexp_extract("html", r"""(?is)<div\b[^>]*\bdata-article-content\b[^>]*>(.*?)<footer\b(?=[^>]*\bclass=["'][^"']*\barticle-footer\b[^"']*["'])""", 1)
    h = F.col("html")
    rules = {
        "no_source": ~body.rlike(r"""(?i)href=["']https?://"""),
        "no_internal_link": ~body.rlike(r"""(?i)href=["']/(?:posts|start-here)/"""),
        "no_author": ~h.rlike(r"""(?i)<a\b[^>]*class=["'][^"']*article-author[^"']*["'][^>]*href=["']/team/["'][^>]*rel=["']author["']"""),
        "encoded_twice": h.rlike("(?i)%25D8|%25D9"),
    }
    return pages.select("page_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))


def shared_values(pages: DataFrame, value: Column, rule: str) -> DataFrame:
    """(page_id, rule, first_page): indexed pages whose value (a title, an address) an earlier page has too."""
    v = pages.where(~noindex(F.col("html"))).select("page_id", value.alias("v")).where("v <> ''")
    first = v.groupBy("v").agg(F.min("page_id").alias("first_page"))
    return v.join(first, "v").where("page_id > first_page").select("page_id", F.lit(rule).alias("rule"), "first_page")


def sitemap_failures(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, rule): addresses of a sitemap (path) without a page, or whose page asks not to be indexed. pages: (path, html)."""
    both = urls.select("path").distinct().join(pages.select("path", noindex(F.col("html")).alias("hidden")).groupBy("path").agg(F.max("hidden").alias("hidden")), "path", "left")
    rule = F.when(F.col("hidden").isNull(), "no_page").when(F.col("hidden"), "noindex")
    return both.select("path", rule.alias("rule")).where("rule is not null")


def legacy_failures(posts: DataFrame, lines: DataFrame) -> DataFrame:
    """Old paths of articles (legacy_path) that no redirect line (value) begins with."""
    from_ = F.regexp_extract(F.trim("value"), r"^(\S+) ", 1)
    return posts.where("legacy_path is not null").join(lines.select(from_.alias("legacy_path")).distinct(), "legacy_path", "left_anti").select("legacy_path")


def picture_failures(files: DataFrame) -> DataFrame:
    """files (name, width, height) whose size is not the one that the name says, 16 to 9."""
    said = F.nullif(F.regexp_extract("name", r"-(320|640|960|1280)\.webp$", 1), F.lit("")).cast("int")
    ok = (F.col("width") == said) & (F.col("height") == numbers.half_up(said * 9 / 16).cast("int"))
    return files.where(~F.coalesce(ok, F.lit(False))).select("name")


def review_failures(posts: DataFrame, review: DataFrame, risky: DataFrame) -> DataFrame:
    """(id, rule, detail) of a pronunciation review. posts: (id, body, visible, spoken); review: (id, body_hash, checks
    array<struct<from, to>>); risky: (word) that must not be spoken without vowel signs."""
    both = posts.join(review.withColumn("_there", F.lit(True)), "id", "full_outer")
    checks = F.coalesce("checks", F.array().cast("array<struct<from:string,to:string>>"))
    phrases = F.transform(checks, lambda c: c["from"])
    one = lambda rule, cond, detail=F.lit(""): F.when(cond, F.array(F.struct(F.lit(rule).alias("rule"), detail.alias("detail")))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>"))
    each = lambda rule, keep_, what: F.transform(F.filter(checks, keep_), lambda c: F.struct(F.lit(rule).alias("rule"), c[what].alias("detail")))
    known = F.col("body").isNotNull() & F.col("_there").isNotNull()
    found = F.concat(
        one("orphan", F.col("body").isNull()), one("no_review", F.col("_there").isNull()), one("changed", known & (F.col("body_hash") != F.sha2("body", 256))),
        F.when(known, F.concat(
            each("phrase_gone", lambda c: ~F.contains(F.col("visible"), c["from"]), "from"), each("not_spoken", lambda c: ~F.contains(F.col("spoken"), c["to"]), "to"),
            each("no_signs", lambda c: ~c["to"].rlike("[\u064B-\u0652\u0670]"), "to"), one("repeated", F.size(F.array_distinct(phrases)) < F.size(phrases)))).otherwise(F.array().cast("array<struct<rule:string,detail:string>>")))
    by_rule = both.select("id", F.explode(found).alias("f")).select("id", "f.rule", "f.detail")
    quoted = F.concat(F.lit(r"(^|[^\p{L}])\Q"), F.col("word"), F.lit(r"\E($|[^\p{L}])"))
    words = posts.crossJoin(bounded(risky)).where(F.contains("visible", F.col("word")) & F.call_function("rlike", F.col("spoken"), quoted))
    return by_rule.unionByName(words.select("id", F.lit("risky").alias("rule"), F.col("word").alias("detail")))


#: Rows of a hand-kept list that are broadcast at most.
LIST_ROWS = 100_000


def bounded(rows: DataFrame) -> DataFrame:
    """A hand-kept list, broadcast if it is as short as such lists are; beyond that Spark chooses."""
    return F.broadcast(rows) if rows.limit(LIST_ROWS + 1).count() <= LIST_ROWS else rows


def token_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, rule): files (file, text) that do not match the pattern (required) or do (not required) of rules (file,
    rule, pattern, required)."""
    both = rules.join(files, "file", "left")
    holds = F.coalesce(F.call_function("rlike", F.col("text"), F.col("pattern")), F.lit(False))
    return both.where(holds != F.col("required")).select("file", "rule")


def report(failures: DataFrame, most: int = 150) -> DataFrame:
    """The first failures in order: a report that someone reads."""
    return failures.orderBy(*failures.columns).limit(most)


def duplicate_titles(pages: DataFrame) -> DataFrame:
    title = text.plain_html(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title")).where("title <> ''").groupBy("title").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page")).where("pages > 1")


#: Bytes of needles that are broadcast in one pass; further needles take further passes.
LEAK_BYTES = 16 << 20
#: Characters of a needle that the automaton knows; what follows is compared at the place found.
LEAK_KEY = 64


class Needles:
    """Texts of one beginning, in order, each with the longest other one that it begins with. Of all that a text goes on
    with at some place, the longest is the last one in order that is not behind it, or one of those this begins with."""

    def __init__(self, rows: dict[str, list[int]]):
        self.texts = sorted(rows)
        self.rows, self.longest, self.shorter = [rows[x] for x in self.texts], max(map(len, rows)), []
        open_: list[int] = []
        for k, x in enumerate(self.texts):
            while open_ and not x.startswith(self.texts[open_[-1]]):
                open_.pop()
            self.shorter.append(open_[-1] if open_ else -1)
            open_.append(k)

    def at(self, text: str, start: int) -> Iterator[int]:
        said = text[start : start + self.longest]
        k = bisect_right(self.texts, said) - 1
        while k >= 0 and not said.startswith(self.texts[k]):
            k = self.shorter[k]
        while k >= 0:
            yield from self.rows[k]
            k = self.shorter[k]


def leaks(documents: DataFrame, needles: DataFrame) -> DataFrame:
    """(doc_id, item_id): documents that hold the whole text of an item, anywhere. Empty and null items are in no
    document. Every text passes once through an automaton of the beginnings of the items; where an item begins, those that
    begin alike are looked up together (see Needles), however many there are."""
    doc, item = (t.schema[c].dataType.simpleString() for t, c in ((documents, "doc_id"), (needles, "item_id")))
    n = needles.where("text <> ''").select("item_id", F.col("text").alias("needle")).distinct()
    texts = documents.where("text is not null").select("doc_id", "text")
    blocks = max(1, -(-(n.agg(F.sum(F.octet_length("needle")).alias("b")).first()["b"] or 0) // LEAK_BYTES))

    def found(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = sent.value.column("needle").to_pylist()
            keys: dict[str, dict[str, list[int]]] = {}
            for i, x in enumerate(wanted):
                keys.setdefault(x[:LEAK_KEY], {}).setdefault(x, []).append(i)
            machine = Automaton()
            for k, rows in keys.items():
                machine.add_word(k, (len(k), Needles(rows)))
            machine.make_automaton()
            for b in batches:
                pairs = set()
                for d, t in enumerate(b.column(1).to_pylist()):
                    for end, (size, alike) in machine.iter(t):
                        pairs.update((d, i) for i in alike.at(t, end + 1 - size))
                at = [pa.array([p[k] for p in sorted(pairs)], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(at[0]), sent.value.column("item_id").combine_chunks().take(at[1])], ["doc_id", "item_id"])

        return texts.mapInArrow(run, f"doc_id {doc}, item_id {item}")

    parts = [n.where(F.pmod(F.xxhash64("needle"), F.lit(blocks)) == k).toArrow() for k in range(blocks)]
    send = documents.sparkSession.sparkContext.broadcast
    got = [found(send(p)) for p in parts if p.num_rows]
    return union(*got).distinct() if got else documents.select("doc_id").join(n.select("item_id"), F.lit(False))


def schema_failures(posts: DataFrame) -> DataFrame:
    """(id, rule) for each rule on articles that a row breaks."""
    rules = {
        "no_id": F.col("id").isNull(), "no_title": F.coalesce("title", F.lit("")) == "", "no_date": F.col("published_at").isNull(),
        "many_tags": F.size("tags") > 2, "updated_before_published": F.coalesce(F.col("updated_at") < F.col("published_at"), F.lit(False)),
        "short_text": F.char_length(F.coalesce("body", F.lit(""))) < 50,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())), lambda r: r.isNotNull())
    return posts.select("id", F.explode(broken).alias("rule"))


#: Least lengths of a description and of a summary, and the most tags. Fixed values.
DESCRIPTION, SUMMARY, TAGS = 40, 50, 2


def schema_rules(articles: DataFrame, categories: list[str], series: list[str]) -> DataFrame:
    """(id, rule) for each rule on an article's head that is broken: a title, a long enough description, a known category,
    a known series or none, tags, a width that is positive or none, a summary that is long enough or none."""
    none = F.lit(False)
    rules = {
        "title": F.coalesce(F.col("title"), F.lit("")) == "",
        "description": F.char_length(F.coalesce(F.col("description"), F.lit(""))) < DESCRIPTION,
        "category": ~F.coalesce(F.col("category").isin(categories), none),
        "series": F.coalesce(~F.col("series").isin(series), none),
        "tags": F.coalesce(F.size("tags") > TAGS, none),
        "size": F.coalesce(F.col("width") <= 0, none),
        "summary": F.coalesce(F.char_length("summary") < SUMMARY, none),
    }
    return articles.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule"))


def tokens_in_order(body: Column, tokens: list[str]) -> Column:
    """Whether each token stands after the one before."""
    step = lambda at, t: F.when(at == 0, 0).otherwise(F.coalesce(F.nullif(F.call_function("locate", t, body, at), F.lit(0)) + F.char_length(t), F.lit(0)))
    return F.aggregate(F.array(*map(F.lit, tokens)), F.lit(1), step) > 0


def low_contrast(colours: DataFrame, least: float = 4.5) -> DataFrame:
    return colours.withColumn("ratio", numbers.contrast(F.col("front"), F.col("back"))).where(F.col("ratio") < least)


def unmonotonic(intervals: DataFrame) -> DataFrame:
    """Intervals that start before the one before them, or end before they start."""
    w = Window.partitionBy("article_id").orderBy("ordinal", "type", "text")
    return intervals.withColumn("before", F.lag("start").over(w)).where((F.col("start") < F.col("before")) | (F.col("end") < F.col("start"))).drop("before")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
