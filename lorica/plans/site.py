"""Queries on the pages of a site and their audits, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import audit, feed, site
from ..sources import tables as T
from .oracle import _POSTS, _path
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)


def _published(spark, d):
    return feed.published(T.posts(spark, d))


def _json(x: str) -> str:
    """SQL for a text as a JSON string in which < is an escape."""
    return rf"""('"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: case when c = '"' then '\"' when c = '\' then '\\' when c = '<' then '\u003c' when c = chr(10) then '\n' when c = chr(13) then '\r'
    when c = chr(9) then '\t' when c = chr(8) then '\b' when c = chr(12) then '\f' when unicode(c) < 32 then printf('\u%04X', unicode(c)) else c end), '') || '"')"""


#: Pages that each break one rule, besides those of the table: page_id, html. {q} is a quote.
MADE = [
    (-1, "<html><head><title>One</title></head><body><h1>a</h1><h1>b</h1><p id='x'></p><p id='x'></p><button>go</button><button type='button'>ok</button></body></html>"),
    (-2, "<html><head><title></title><meta name='description' content='short'><link rel='canonical' href='https://e.org/2'></head><body><h1>a</h1><h3>c</h3><a aria-controls='gone' href='#'>x</a><img src='/a.png' width='3'></body></html>"),
    (-3, "<html><head><title>Good page</title><meta name='description' content='A description that is long enough to be shown beneath a link in a list of results.'><link rel='canonical' href='https://e.org/3'></head><body><h1>a</h1><h2>b</h2><img alt='' src='/b.png' width='16' height='9'></body></html>"),
    (-4, "<html><head><title>Good page</title><meta name='robots' content='noindex, follow'></head><body><h1 style='x'>a</h1><script>run()</script><script src='/a.js'></script><img fetchpriority='high' alt='' width='1' height='1'><img fetchpriority='high' alt='' width='1' height='1'></body></html>"),
    (-5, "<html><head><title>Good page</title><meta name='description' content='A description that is long enough to be shown beneath a link in a list of results.'><link rel='canonical' href='https://e.org/3'></head><body><h1>a</h1><a class='post-card-media' href='/x'><img alt='' src='/images/posts/x.png' width='16' height='10'></a></body></html>"),
    (-6, "<html><body><h1>a</h1><div data-article-content><a href='https://out.org'>s</a> <a href='/posts/1/'>i</a></div><footer class='article-footer'></footer><a class='article-author' href='/team/' rel='author'>t</a></body></html>"),
]
_MADE_SQL = "(values " + ", ".join(f"({i}, '{h.replace(chr(39), chr(39) * 2)}')" for i, h in MADE) + ") m(page_id, html)"
_PAGES_SQL = f"pg as (select page_id, html from pages union all select * from {_MADE_SQL})"


def _pages(spark, d):
    return T.table(spark, d, "pages").select("page_id", "html").unionByName(spark.createDataFrame(MADE, "page_id long, html string"))


_TITLE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&(?:amp|quot|#39|lt|gt);', ' ', 'g'), '\s+', ' ', 'g'))"
_NOINDEX = r"""regexp_matches(regexp_extract(html, '(?i)<meta\s+name=["'']robots["'']\s+content=["'']([^"'']*)["'']', 1), '(?i)\bnoindex\b')"""
_CANONICAL = r"""regexp_extract(html, '(?i)<link\s+rel=["'']canonical["'']\s+href=["'']([^"'']+)["'']', 1)"""


@query(rf"""with {_PAGES_SQL}, x as (select page_id, html, {_TITLE} as title, {_NOINDEX} as hidden, {_CANONICAL} as canon,
    trim(regexp_extract(html, '(?i)<meta\s+name=["'']description["'']\s+content=["'']([^"'']*)["'']', 1)) as descr,
    regexp_extract_all(html, '(?i)\bid=["'']([^"'']+)["'']', 1) as ids, regexp_extract_all(html, '(?i)<img\b[^>]*>') as images, regexp_extract_all(html, '(?i)<button\b[^>]*>') as buttons,
    list_transform(regexp_extract_all(coalesce(nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*?)</main>', 1), ''), html), '(?i)<h([1-6])\b', 1), lambda v: v::int) as levels,
    regexp_extract_all(html, '(?is)<script\b([^>]*)>', 1) as attrs, regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script>', 1) as bodies,
    list_filter(list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*class=["''][^"'']*post-card-media[^"'']*["''][^>]*>(.*?)</a>', 1), lambda c: regexp_extract(c, '(?i)<img\b[^>]*>')), lambda c: c <> '') as cards from pg),
  r as (select page_id, unnest([
    {{'rule': 'h1', 'detail': case when len(regexp_extract_all(html, '(?i)<h1\b')) <> 1 then len(regexp_extract_all(html, '(?i)<h1\b')) end}},
    {{'rule': 'duplicate_ids', 'detail': nullif(len(ids) - len(list_distinct(ids)), 0)}},
    {{'rule': 'button_type', 'detail': nullif(len(list_filter(buttons, lambda b: not regexp_matches(b, '(?i)\btype=["''](?:button|submit|reset)["'']'))), 0)}},
    {{'rule': 'aria_controls', 'detail': nullif(len(list_filter(list_distinct(regexp_extract_all(html, '(?i)\baria-controls=["'']([^"'']+)["'']', 1)), lambda a: not list_contains(ids, a))), 0)}},
    {{'rule': 'image_alt', 'detail': nullif(len(list_filter(images, lambda i: not regexp_matches(i, '(?i)\balt=["''][^"'']*["'']'))), 0)}},
    {{'rule': 'image_size', 'detail': nullif(len(list_filter(images, lambda i: not (regexp_matches(i, '(?i)\bwidth=["'']\d+["'']') and regexp_matches(i, '(?i)\bheight=["'']\d+["'']')))), 0)}},
    {{'rule': 'inline_style', 'detail': nullif(len(regexp_extract_all(html, '(?i)\sstyle=["''][^"'']*["'']')), 0)}},
    {{'rule': 'card_thumbnail', 'detail': nullif(len(list_filter(cards, lambda c: not regexp_matches(c, '(?i)\bsrc=["'']/images/thumbnails/'))), 0)}},
    {{'rule': 'card_shape', 'detail': nullif(len(list_filter(cards, lambda c: coalesce(try_cast(regexp_extract(c, '(?i)\bwidth=["''](\d+)["'']', 1) as int) * 9 <> try_cast(regexp_extract(c, '(?i)\bheight=["''](\d+)["'']', 1) as int) * 16, true))), 0)}},
    {{'rule': 'priority', 'detail': case when len(regexp_extract_all(html, '(?i)<img\b[^>]*\bfetchpriority=["'']high["''][^>]*>')) > 1 then len(regexp_extract_all(html, '(?i)<img\b[^>]*\bfetchpriority=["'']high["''][^>]*>')) end}},
    {{'rule': 'empty_link', 'detail': nullif(len(regexp_extract_all(html, '(?i)\b(?:href|src)=["'']#?["'']')), 0)}},
    {{'rule': 'heading_jump', 'detail': list_filter(list_transform(range(2, len(levels) + 1), lambda i: case when levels[i] > levels[i - 1] + 1 then levels[i - 1] * 10 + levels[i] end), lambda j: j is not null)[1]}},
    {{'rule': 'no_title', 'detail': case when title = '' then 1 end}}, {{'rule': 'no_description', 'detail': case when descr = '' then 1 end}}, {{'rule': 'no_canonical', 'detail': case when canon = '' then 1 end}},
    {{'rule': 'long_title', 'detail': case when not hidden and length(title) > 70 then length(title) end}},
    {{'rule': 'description_length', 'detail': case when not hidden and descr <> '' and length(descr) not between 70 and 160 then length(descr) end}},
    {{'rule': 'inline_script', 'detail': nullif(len(list_filter(range(1, len(bodies) + 1), lambda i: not regexp_matches(attrs[i], '(?i)\bsrc=') and not regexp_matches(attrs[i], '(?i)type=["''](?:application/ld\+json|application/json)["'']') and trim(bodies[i]) <> '')), 0)}}]) as u from x)
  select page_id, u.rule as rule, u.detail::bigint as detail from r where u.detail is not null""")
def page_audit_failures(spark, d):
    return audit.page_failures(_pages(spark, d))


@query(rf"""with {_PAGES_SQL}, b as (select page_id, html, case when regexp_matches(html, '(?i)<div\b[^>]*\bdata-article-content\b') then regexp_extract(html, '(?is)<div\b[^>]*\bdata-article-content\b[^>]*>(.*?)<footer\b[^>]*\barticle-footer\b', 1) else '' end as body from pg),
  r as (select page_id, unnest([case when not regexp_matches(body, '(?i)href=["'']https?://') then 'no_source' end, case when not regexp_matches(body, '(?i)href=["'']/(?:posts|start-here)/') then 'no_internal_link' end,
    case when not regexp_matches(html, '(?i)<a\b[^>]*class=["''][^"'']*article-author[^"'']*["''][^>]*href=["'']/team/["''][^>]*rel=["'']author["'']') then 'no_author' end, case when regexp_matches(html, '(?i)%25D8|%25D9') then 'encoded_twice' end]) as rule from b)
  select * from r where rule is not null""")
def article_page_failures(spark, d):
    return audit.article_failures(_pages(spark, d))


@query(rf"""with {_PAGES_SQL}, v as (select page_id, 'title' as rule, {_TITLE} as v from pg where not {_NOINDEX} union all select page_id, 'canonical', {_CANONICAL} from pg where not {_NOINDEX}),
  f as (select rule, v, min(page_id) as first_page from v where v <> '' group by all) select page_id, rule, first_page from v join f using (rule, v) where page_id > first_page""")
def shared_page_values(spark, d):
    p = _pages(spark, d)
    return audit.shared_values(p, audit.page_title(F.col("html")), "title").unionByName(audit.shared_values(p, audit.canonical(F.col("html")), "canonical"))


@query(rf"""with p as (select {_path("url")} as path, page_id % 10 = 0 as hidden from pages), u as (select distinct {_path("url")} as path from pages where page_id % 3 = 0 union select '/gone'),
  b as (select u.path, max(case when p.path is null then null when hidden then 1 else 0 end) as h from u left join p using (path) group by u.path)
  select path, case when h is null then 'no_page' else 'noindex' end as rule from b where h is null or h = 1""")
def sitemap_failures(spark, d):
    p = T.table(spark, d, "pages").select("page_id", audit.page_path(F.col("url")).alias("path"))
    html = F.when(F.col("page_id") % 10 == 0, "<meta name='robots' content='noindex, follow'>").otherwise("<p>")
    urls = p.where("page_id % 3 = 0").select("path").unionByName(spark.createDataFrame([("/gone",)], "path string"))
    return audit.sitemap_failures(urls, p.select("path", html.alias("html")))


@query(rf"""select distinct '/' || n_name as legacy_path from nation where n_nationkey % 4 = 0""")
def legacy_path_failures(spark, d):
    n = T.table(spark, d, "nation")
    lines = n.where("n_nationkey % 4 <> 0").select(F.concat(F.lit(" /"), F.col("n_name"), F.lit(" /posts/x/ 301")).alias("value"))
    return audit.legacy_failures(n.select(F.concat(F.lit("/"), F.col("n_name")).alias("legacy_path")), lines)


@query("select 'p' || p_partkey || '-' || case when p_partkey % 5 = 0 then 300 else 640 end || '.webp' as name from part where p_partkey % 5 = 0 or p_partkey % 7 = 0")
def picture_size_failures(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.lit("p"), k.cast("string"), F.lit("-"), F.when(k % 5 == 0, "300").otherwise("640"), F.lit(".webp"))
    return audit.picture_failures(T.table(spark, d, "part").select(name.alias("name"), F.lit(640).alias("width"), F.when(k % 7 == 0, 361).otherwise(360).alias("height")))


@query("""with f as (select c_custkey as file, c_name || ' ' || c_mktsegment as text from customer), r as (select file, rule, pattern, req from f, (values ('building', 'BUILDING', true), ('no_nine', '9$', false), ('digits', '#[0-9]+ ', true)) v(rule, pattern, req))
  select file, rule from r join (select file, text from f) using (file) where regexp_matches(text, pattern) <> req union all select -1, 'building'""")
def token_rule_failures(spark, d):
    files = T.table(spark, d, "customer").select(F.col("c_custkey").alias("file"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    kinds = spark.createDataFrame([("building", "BUILDING", True), ("no_nine", "9$", False), ("digits", "#[0-9]+ ", True)], "rule string, pattern string, required boolean")
    rules = files.select("file").crossJoin(F.broadcast(kinds)).unionByName(spark.createDataFrame([(-1, "building", "BUILDING", True)], "file long, rule string, pattern string, required boolean"))
    return audit.token_rules(files, rules)


@query(f"""with {_POSTS}, r as (select id as i, case when id % 5 = 1 then 'old' else sha256(body) end as h, id % 5 as k from posts where id % 5 <> 0),
  v as (select posts.*, r.*, left(title, 5) as w from posts left join r on i = id)
  select id, 'no_review' as rule, '' as detail from v where i is null union all select -5, 'orphan', '' union all select id, 'changed', '' from v where k = 1
  union all select id, 'phrase_gone', 'nowhere to be found' from v where k = 2 union all select id, 'not_spoken', 'never said' from v where k = 2 union all select id, 'no_signs', 'never said' from v where k = 2
  union all select id, 'no_signs', w from v where k in (3, 4) union all select id, 'no_signs', w from v where k = 4 union all select id, 'repeated', '' from v where k = 4
  union all select id, 'risky', 'the' from v where regexp_matches(title, '(^|[^\\p{{L}}])the($|[^\\p{{L}}])')""")
def speech_review(spark, d):
    p = _published(spark, d).select("id", "body", F.col("title").alias("visible"), F.col("title").alias("spoken"))
    word = F.left("visible", F.lit(5))
    same = F.struct(word.alias("from"), word.alias("to"))
    checks = F.when(F.col("id") % 5 == 2, F.array(F.struct(F.lit("nowhere to be found").alias("from"), F.lit("never said").alias("to")))).when(F.col("id") % 5 == 3, F.array(same)).when(F.col("id") % 5 == 4, F.array(same, same))
    review = p.where("id % 5 <> 0").select("id", F.when(F.col("id") % 5 == 1, "old").otherwise(F.sha2("body", 256)).alias("body_hash"), checks.alias("checks"))
    orphan = spark.createDataFrame([(-5, "x", None)], "id long, body_hash string, checks array<struct<from:string,to:string>>")
    return audit.review_failures(p, review.unionByName(orphan), spark.createDataFrame([("the",)], "word string"))


@query(f"""with {_POSTS}, s as (select series_slug as k, count(*) as n from posts where series_slug is not null group by 1), t as (select tag, count(*) as n from (select distinct id, unnest(tags) as tag from posts) group by 1),
  c as (select slug, count(id) as n from categories left join posts on category_slug = slug group by 1)
  select '/posts/' || id || '/' as path, 'article' as kind, md5('{{"id":' || id || ',"title":' || {_json("title")} || case when category_slug is null then '' else ',"category":' || {_json("category_slug")} end || '}}') as props from posts
  union all select '/category/' || slug || '/', 'category', md5('{{"slug":"' || slug || '","articles":' || n || '}}') from c
  union all select '/series/' || k || '/', 'series', md5('{{"slug":"' || k || '","articles":' || n || ',"noindex":' || (n < 2)::varchar || '}}') from s
  union all select '/tags/' || tag || '/', 'tag', md5('{{"tag":"' || tag || '","articles":' || n || ',"noindex":' || (n < 3)::varchar || '}}') from t""")
def page_routes(spark, d):
    return site.routes(_published(spark, d), T.categories(spark, d)).select("path", "kind", F.md5("props").alias("props"))


@query(f"""with {_POSTS}, n as (select * from posts order by published_at desc, id limit 50),
  i as (select id, published_at, '<item><title>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</title><link>https://example.org/posts/' || id || '/</link><pubDate>' || strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate></item>' as line from n)
  select md5('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Feed</title>' || string_agg(line, '' order by published_at desc, id) || '</channel></rss>') as document from i""")
def rss_document(spark, d):
    p = _published(spark, d)
    items = feed.rss_items(p, "https://example.org").join(p.select("id", "published_at"), "id")
    return site.rss_document(items, "Feed").select(F.md5("document").alias("document"))


@query(f"""with {_POSTS}, u as (select '/posts/' || id || '/' as path, strftime(coalesce(updated_at, published_at), '%Y-%m-%d') as lastmod from posts),
  n as (select *, (row_number() over (order by path) - 1) // 100 as part from u)
  select part, md5('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' || string_agg('<url><loc>https://example.org' || path || '</loc><lastmod>' || lastmod || '</lastmod></url>', '' order by path) || '</urlset>') as document from n group by part""")
def sitemap_documents(spark, d):
    """Sitemaps of 100 addresses each, whole."""
    p = _published(spark, d).select(F.concat(F.lit("/posts/"), F.col("id").cast("string"), F.lit("/")).alias("path"), F.date_format(feed.changed_at(), "yyyy-MM-dd").alias("lastmod"))
    return site.sitemap_documents(p, "https://example.org", 100).select("part", F.md5("document").alias("document"))


@query(f"""with {_POSTS} select id, md5('{{"headline":' || {_json("title")} || ',"datePublished":"' || strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') || '","dateModified":"' || strftime(coalesce(updated_at, published_at), '%Y-%m-%dT%H:%M:%S.000Z')
  || '","mainEntityOfPage":"https://example.org/posts/' || id || '/"' || case when category_slug is null then '' else ',"articleSection":' || {_json("category_slug")} end || ',"keywords":"' || array_to_string(tags, ', ') || '"}}') as json from posts""")
def article_schema(spark, d):
    return site.schema_json(_published(spark, d), "https://example.org").select("id", F.md5("json").alias("json"))


@query("""select p_partkey as id, w as width, floor(w * 9 / 16.0 + 0.5)::int as height, 'c' || p_partkey || '-' || w || '.webp' as target from part, (values (320), (640), (960), (1280)) v(w)""")
def picture_plan(spark, d):
    files = T.table(spark, d, "part").select("p_partkey", F.concat(F.lit("/images/c"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("file"))
    return site.picture_plan(files.select("file")).join(files, "file").select(F.col("p_partkey").alias("id"), "width", "height", "target")


@query(f"""with {_POSTS} select 'tag' as what, count(*) as n from posts where list_contains(tags, 't3') union all select 'facet', count(*) from posts where category_slug = 'en' union all select 'all', count(*) from posts union all select 'saved', count(*) from posts where id % 7 = 0""")
def facet_counts(spark, d):
    p = _published(spark, d)
    saved = p.where("id % 7 = 0").select("id").unionByName(spark.createDataFrame([(-3,)], "id long"))
    parts = {"tag": site.with_tag(p, "t3"), "facet": site.faceted(p, "en"), "all": site.faceted(p, "all"), "saved": site.in_list(p, saved)}
    return audit.union(*(df.agg(F.lit(k).alias("what"), F.count("*").alias("n")) for k, df in parts.items()))


@query(f"""with {_POSTS} select id, coalesce(case when id % 2 = 0 then 'own' || id end, case when id % 3 = 0 then 'image' || id end, 'category') as picture, case when id % 4 = 0 then '/,/a/' else '/a/' end as active,
  'https%3A%2F%2Fexample.org%2Fposts%2F%D8%A7%2F' || id as share from (select *, id as i from posts)""")
def card_values(spark, d):
    """Fallbacks, the active entry of a menu, and addresses within addresses."""
    i = F.col("id").cast("string")
    picture = site.thumbnail(F.when(F.col("id") % 2 == 0, F.concat(F.lit("own"), i)), F.when(F.col("id") % 3 == 0, F.concat(F.lit("image"), i)), F.lit("category"))
    menu = F.array(F.lit("/"), F.lit("/a/"), F.lit("/b/"))
    home, below = site.navigation(menu, F.lit("/")), site.navigation(menu, F.lit("/a/x/"))
    active = F.when(F.col("id") % 4 == 0, F.concat(home, below)).otherwise(below)
    return _published(spark, d).select("id", picture.alias("picture"), F.array_join(active, ",").alias("active"), site.share_url("https://example.org", F.concat(F.lit("/posts/%D8%A7/"), i)).alias("share"))


@query(rf"""with {_POSTS} select id, len(regexp_extract_all(body, '(?m)^##[ \t]+(.+?)[ \t]*$', 1)) as headings, sha256(concat('{{"id":', id, case when category_slug is null then '' else ',"category":"' || category_slug || '"' end, '}}')) as print from posts""")
def article_prints(spark, d):
    """Headings of level 2, and a fingerprint of fields in order, null ones left out."""
    return _published(spark, d).select("id", F.size(site.level_two(F.col("body"))).alias("headings"), numbers.fingerprint("id", F.col("category_slug").alias("category")).alias("print"))
