"""Queries on smaller rules of pages, pictures and narration, each with its DuckDB SQL."""

from __future__ import annotations

import sys

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit, feed, speech, work
from ..sources import tables as T
from ..sources.commands import piped
from .oracle import _POSTS
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)


def _published(spark, d):
    return feed.published(T.posts(spark, d))


@query(f"""with {_POSTS}, p as (select id, title, left(title, cast(id % 61 as int)) || case when id % 9 = 0 then '𝄞' else '' end as short from posts),
  u as (select *, short || ' | Lorica' as branded, case when id % 9 = 0 then 1 else 0 end as pairs from p)
  select id, case when length(branded) + pairs <= 65 then branded else short end as title,
    case when id % 3 = 0 then '/images/social/p' || id || '-social.jpg' when id % 3 = 1 then '/images/social/t' || id || '-social.jpg' else '/other/x' || id || '.png' end as social,
    case when id % 3 = 0 then '/images/generated/p' || id || '-320.webp' when id % 3 = 1 then '/images/thumbnails/t' || id || '-320.webp' else '/other/x' || id || '.png' end as thumbnail from u""")
def head_values(spark, d):
    """Titles with the brand as long as they fit, and the pictures that stand for an article."""
    i = F.col("id").cast("string")
    short = F.concat(F.left("title", (F.col("id") % 61).cast("int")), F.when(F.col("id") % 9 == 0, "𝄞").otherwise(""))
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("/images/posts/p"), i, F.lit(".jpg"))).when(F.col("id") % 3 == 1, F.concat(F.lit("/images/thumbnails/t"), i, F.lit(".webp"))).otherwise(F.concat(F.lit("/other/x"), i, F.lit(".png")))
    return _published(spark, d).select("id", text.branded_title(short, "Lorica", "all of it").alias("title"), text.picture_of(path, "social").alias("social"), text.picture_of(path, "thumbnail").alias("thumbnail"))


@query(r"""with p as (select page_id, html || '<img data-src="/d' || page_id % 7 || '.png" srcset="/s' || page_id % 5 || '-320.webp 320w,  /s-640.webp 640w,//cdn/x.webp 2x">' as html from pages),
  t as (select page_id, unnest(regexp_extract_all(html, '\b(?:href|src|data-src)=["'']([^"'']+)["'']', 1)) as target from p
    union all select page_id, regexp_extract(trim(unnest(string_split(s, ','))), '^\S+') from (select page_id, unnest(regexp_extract_all(html, '\bsrcset=["'']([^"'']+)["'']', 1)) as s from p))
  select target, count(*) as n, count(distinct page_id) as pages from t where target like '/%' and target not like '//%' group by target""")
def internal_targets(spark, d):
    """How often the pages lead to each place of their own site, pictures of every width included."""
    k = F.col("page_id")
    picture = F.format_string('<img data-src="/d%d.png" srcset="/s%d-320.webp 320w,  /s-640.webp 640w,//cdn/x.webp 2x">', k % 7, k % 5)
    pages = T.table(spark, d, "pages").select("page_id", F.concat("html", picture).alias("html"))
    own = audit.links(pages).where(F.col("target").startswith("/") & ~F.col("target").startswith("//"))
    return own.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query("select page_id, case page_id % 5 when 0 then '/' when 1 then '/404' when 2 then '/posts/' || page_id || '/' when 3 then '/a' || page_id else '/index/' || page_id || '/x' end as path from pages")
def paths_of_files(spark, d):
    k = F.col("page_id").cast("string")
    r = F.col("page_id") % 5
    file = F.when(r == 0, "index.html").when(r == 1, "404.html").when(r == 2, F.concat(F.lit("posts/"), k, F.lit("/index.html"))).when(r == 3, F.concat(F.lit("a"), k, F.lit(".html"))).otherwise(F.concat(F.lit("index/"), k, F.lit("/x.html")))
    return T.table(spark, d, "pages").select("page_id", audit.file_path(file).alias("path"))


_PIECES = "s as (select conv_id as a, turn // 4 as part, turn, role, coalesce(text, '') as t, case when turn = 0 then 'title' when role = 'assistant' then 'h2' else role end as k from conversations)"


def _pieces(spark, d):
    s = T.segments(spark, d)
    kind = F.when(F.col("ordinal") == 0, "title").when(F.col("type") == "assistant", "h2").otherwise(F.col("type"))
    return s.select("article_id", F.floor(F.col("ordinal") / 4).alias("part"), F.struct("ordinal", F.col("type").alias("role"), "text").alias("pos"), kind.alias("type"), "text")


@query(rf"""with {_PIECES}, e as (select *, '<prosody rate="-5%">' || replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</prosody>' as b from s),
  p as (select a, part, '<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis" xml:lang="ar-SA"><voice name="v">' || string_agg('<p>' || case when k = 'title' then b || '<break time="260ms"/>' when k = 'h2' then '<break time="160ms"/>' || b || '<break time="180ms"/>' else b end || '</p>', '' order by turn, role, t) || '</voice></speak>' as x from e group by a, part)
  select a as article_id, part, md5(x) as ssml, octet_length(encode(x)) < 64000 as fits from p""")
def speech_requests(spark, d):
    return speech.ssml(_pieces(spark, d), "v", rate="-5%").select("article_id", "part", F.md5("ssml").alias("ssml"), "fits")


@query(f"""with {_PIECES}, p as (select a, part, string_agg(t, ' ' order by turn, role, t) as t from s group by a, part), n as (select *, count(*) over (partition by a) as n from p)
  select a as article_id, part, md5('Read calmly.' || chr(10) || chr(10) || '### CONTEXT (not read aloud)' || chr(10) || 'Topic: Talk ' || a || ' again' || chr(10) || case when n > 1 then 'This is part ' || part + 1 || ' of ' || n || '; voice and distance stay the same.' else '' end || chr(10) || chr(10) || '### TRANSCRIPT' || chr(10) || t) as prompt from n""")
def speech_prompts(spark, d):
    rows = _pieces(spark, d).groupBy("article_id", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("l"))
    parts = rows.select("article_id", F.concat(F.lit("\n Talk "), F.col("article_id").cast("string"), F.lit("\r\nagain\n")).alias("title"), "part", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))
    return speech.prompts(parts, "Read calmly.").select("article_id", "part", F.md5("prompt").alias("prompt"))


_LISTS = """l as (select l_orderkey as a, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as pos, l_quantity::bigint as q, l_suppkey % 23 as h from lineitem),
  u as (select *, sum(q) over (partition by a order by pos) as upto, sum(q) over (partition by a) as total from l)"""


def _lists(spark, d):
    li = T.table(spark, d, "lineitem")
    w = Window.partitionBy("article_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "q")
    rows = li.select(F.col("l_orderkey").alias("article_id"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    rows = rows.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("upto", F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    h, block = F.col("l_suppkey") % 23, lambda off: F.format_string("block-%03d", F.col("pos") + 1 + off)
    blocks = rows.where(h != 1).select("article_id", "pos", block(F.when(h == 2, 1).otherwise(0)).alias("block"), (F.col("upto") - F.col("q")).alias("start"), (F.col("upto") + F.when(h == 3, 10**6).otherwise(0)).alias("end"))
    segments = rows.where(h != 4).select("article_id", "pos", F.concat(F.lit("s"), F.col("pos").cast("string")).alias("id"), F.lit("p").alias("type"))
    parts = rows.where(h != 5).select("article_id", "pos", block(0).alias("block"), F.col("q").alias("seconds"))
    return speech.zipped(blocks, segments, parts), rows.groupBy("article_id").agg(F.sum("q").alias("seconds"))


@query(f"""with {_LISTS} select a as article_id, pos, 'missing' as rule from u where h in (1, 4, 5) union all select a, pos, 'order' from u where h = 2 union all select a, pos, 'time' from u where h = 3
  union all select a, null, 'sum' from u group by a having max(total) - coalesce(sum(q) filter (where h <> 5), -1) > 0.1 or count(*) filter (where h <> 5) = 0""")
def lists_side_by_side(spark, d):
    """Blocks, segments and parts of a recording by their places: what is missing, out of order or out of time."""
    return speech.zip_failures(*_lists(spark, d))


@query(f"""with {_LISTS} select a as article_id, pos, round((upto - q) / total, 9) as start, case when pos = max(pos) over (partition by a) then 1 else round(upto / total, 9) end as "end" from u where h not in (1, 3)""")
def synced_segments(spark, d):
    rows, totals = _lists(spark, d)
    sound = rows.where("timed is not null and end < 1000000")
    return speech.synced(sound, totals).select("article_id", "pos", "start", "end")


@query("select s_suppkey as id, case s_suppkey % 3 when 0 then 'first' when 1 then 'second' end as title, case s_suppkey % 3 when 0 then 'one' when 1 then 'two' end as description from supplier")
def series_meta(spark, d):
    """Articles with the title and description of their series, by a short list that need not have it."""
    posts = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("series_slug"))
    known = spark.createDataFrame([("k0", "first", "one"), ("k1", "second", "two"), ("k9", "unused", "")], "slug string, title string, description string")
    return feed.with_series(posts, known).select("id", "series.title", "series.description")


@query("with w as (select lpad(cast(p_partkey as varchar), 8, '0') as article_id, p_size as requests from part where p_partkey % 3 <> 0) select article_id from w order by requests, article_id limit 20")
def shortest_by_name(spark, d):
    """The shortest jobs first, equal ones by their names in the order of the language."""
    p = T.table(spark, d, "part").where("p_partkey % 3 <> 0")
    return work.next_work(p.select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("article_id"), F.col("p_size").alias("requests")), 20).select("article_id")


@query(f"with {_PIECES}, g as (select a, part, sum(length(t)) as c, sum(octet_length(encode(t))) as b from s group by a, part) select count(distinct a) as articles, count(*) as requests, sum(c)::bigint as characters, sum(b)::bigint as bytes from g")
def request_totals(spark, d):
    """Articles, requests, characters and bytes of a whole plan."""
    parts = _pieces(spark, d).groupBy("article_id", "part").agg(F.sum(F.char_length("text")).alias("c"), F.sum(F.octet_length("text")).alias("b"))
    return parts.agg(F.countDistinct("article_id").alias("articles"), F.count("*").alias("requests"), F.sum("c").alias("characters"), F.sum("b").alias("bytes"))


#: A program that reads articles as lines of JSON and prints what it has counted, leaving every seventh one out.
_COUNTER = """
import json, sys
for line in sys.stdin:
    r = json.loads(line)
    if r["doc_id"] % 7:
        print(json.dumps({"id": r["doc_id"], "characters": len(r["text"] or ""), "spaces": (r["text"] or "").count(" ")}))
"""


@query("select doc_id as id, length(coalesce(text, '')) as characters, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) as spaces from documents where doc_id % 7 <> 0")
def counted_by_a_program(spark, d):
    """Documents through a program of its own in each partition."""
    docs = T.table(spark, d, "documents").select("doc_id", "text")
    return piped(docs, [sys.executable, "-c", _COUNTER], "id long, characters long, spaces long")
