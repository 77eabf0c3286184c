"""Queries on manifests and their audits, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import lab, manifests
from ..sources import tables as T
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)

#: Plans from conversations: four turns a part. By article modulo 6 a plan has a fault.
_PLAN_SQL = """t as (select conv_id as article_id, row_number() over (partition by conv_id order by turn, role, coalesce(text, '')) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
  e as (select *, case when article_id % 6 = 1 and i = 0 then 'x1' else printf('b%04d', i + 1) end as seg, case when article_id % 6 = 2 and i = 0 then 'b9999' else printf('b%04d', i + 1) end as eid,
    case when article_id % 6 = 3 and i % 4 = 1 then -1.0 else (i % 4) * 0.25 end as s, (i % 4) * 0.25 + 0.25 as f, i // 4 as part from t where not (article_id % 6 = 4 and i = n - 1 and n > 1))"""


def _plans(spark, d):
    c = T.segments(spark, d)
    w = Window.partitionBy("article_id").orderBy("ordinal", "type", "text")
    i, a = F.col("i"), F.col("article_id")
    t = c.withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("article_id"))})
    name = F.format_string("b%04d", i + 1)
    entry = F.struct(
        F.when((a % 6 == 2) & (i == 0), "b9999").otherwise(name).alias("id"), F.lit("p").alias("type"),
        F.when((a % 6 == 3) & (i % 4 == 1), -1.0).otherwise(i % 4 * 0.25).alias("start"), (i % 4 * 0.25 + 0.25).alias("end"))
    t = t.withColumns({"seg": F.when((a % 6 == 1) & (i == 0), "x1").otherwise(name), "e": entry, "gone": (a % 6 == 4) & (i == F.col("n") - 1) & (F.col("n") > 1)})
    parts = t.where("not gone").groupBy("article_id", F.floor(i / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", "e"))).alias("s"))
    parts = parts.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("part", "s"))).alias("p"))
    sync = F.transform("p", lambda x: F.transform(x["s"], lambda y: y["e"])).cast(f"array<{manifests.SYNC}>")
    segments = t.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("i", "seg"))).alias("g"))
    return segments.join(parts, "article_id").select("article_id", F.transform("g", lambda x: x["seg"]).alias("segments"), sync.alias("parts"))


@query(f"""with {_PLAN_SQL.replace("where not (article_id % 6 = 4 and i = n - 1 and n > 1))", ")")}, r as (select * from e where not (article_id % 6 = 4 and i = n - 1 and n > 1)),
  o as (select *, lag(s) over (partition by article_id, part order by i) as before from r)
  select article_id, 'form' as rule, seg as id from e where not regexp_matches(seg, '^b[0-9]{{4}}$')
  union all select article_id, 'unknown', eid from (select distinct article_id, eid from r) where (article_id, eid) not in (select article_id, seg from e)
  union all select article_id, 'ratio', eid from r where not (s >= 0 and f <= 1 and s < f)
  union all select article_id, 'order', eid from o where s < before
  union all select article_id, 'never', seg from (select distinct article_id, seg from e) where (article_id, seg) not in (select article_id, eid from r)""")
def sync_plan_failures(spark, d):
    return manifests.sync_failures(_plans(spark, d))


@query("select count(distinct conv_id) as articles, sum((n - case when conv_id % 6 = 4 and n > 1 then 1 else 0 end + 3) // 4)::bigint as parts, sum(n)::bigint as segments from (select conv_id, count(*) as n from conversations group by conv_id)")
def sync_plan_totals(spark, d):
    return manifests.totals(_plans(spark, d))


def _manifests(spark, d):
    """One manifest for each order: a part for each line, two voices, and a fault by order modulo 11."""
    li, k = T.table(spark, d, "lineitem"), F.col("l_orderkey")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
    rows = li.select("l_orderkey", (F.row_number().over(w) - 1).alias("i"), F.col("l_quantity").cast("double").alias("q"))
    i, q = F.col("i").cast("string"), F.col("q")
    key = F.concat(F.lit("k"), k.cast("string"))
    src = lambda v: F.concat(F.when(k % 11 == 4, "/else/").otherwise("/audio/"), key, F.lit("/"), F.when(k % 11 == 5, "same").otherwise(F.concat(F.lit(v), i)), F.lit(".mp3"))
    one = lambda v: F.struct(src(v).alias("src"), F.when(k % 11 == 6, 5).otherwise(1000).cast("bigint").alias("bytes"), F.lit("").alias("sha256"), q.alias("seconds"))
    audio = F.when((k % 11 == 7) & (F.col("i") == 0), F.create_map(F.lit("a"), one("a"))).otherwise(F.create_map(F.lit("a"), one("a"), F.lit("b"), one("b")))
    start = F.when(k % 11 == 8, 1.0).otherwise(0.0)
    sync = F.array(F.struct(F.concat(F.lit("s"), i).alias("id"), F.lit("p").alias("type"), start.alias("start"), F.lit(1.0).alias("end")))
    part = F.struct(sync.alias("sync"), audio.alias("audio"), F.lit(None).cast("string").alias("src"))
    m = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("_o"), F.sum("q").alias("total"), F.collect_list(F.struct("i", part.alias("part"))).alias("ps"))
    parts = F.transform(F.array_sort("ps", lambda x, y: x["i"].cast("int") - y["i"].cast("int")), lambda x: x["part"]).cast(manifests.PARTS)
    voice = lambda v: F.struct(F.lit(v).alias("id"), F.lit(f"P-{v}").alias("provider_voice"), F.when((k % 11 != 2) | (F.lit(v) == "a"), v).alias("label"), (F.col("total") + F.when(k % 11 == 9, 1.0).otherwise(0.05)).alias("seconds"))
    return m.select(
        k.alias("article_id"), (k % 4 + 2).cast("int").alias("version"), F.when(k % 11 == 1, "other").otherwise(F.md5(k.cast("string"))).alias("source_hash"),
        F.when(k % 11 == 3, "z").otherwise("b").alias("default_voice"), F.array(voice("a"), voice("b")).cast(manifests.VOICES).alias("voices"), parts.alias("parts"))


def _wanted(spark, d):
    o = T.table(spark, d, "lineitem").select("l_orderkey").distinct()
    return o.select(F.col("l_orderkey").alias("article_id"), F.md5(F.col("l_orderkey").cast("string")).alias("wanted_hash"), F.concat(F.lit("k"), F.col("l_orderkey").cast("string")).alias("key"))


_BROKEN = """m as (select distinct l_orderkey as k, l_orderkey % 4 + 2 as v, l_orderkey % 11 as f from lineitem),
  b as (select k, 'version' as rule from m where v = 2 union all select k, r from (select k, v, unnest(case f when 1 then ['source'] when 2 then ['voices'] when 3 then ['default_voice'] when 4 then ['assets'] when 5 then ['paths']
    when 6 then case when v = 5 then [] else ['assets'] end when 7 then case when v = 5 then ['assets', 'seconds'] else ['assets'] end when 8 then case when v = 3 then [] else ['sync'] end when 9 then case when v = 5 then ['seconds'] else [] end else [] end) as r from m where v > 2))"""


@query(f"with {_BROKEN} select k as article_id, rule from b")
def manifest_failures(spark, d):
    return manifests.failures(_manifests(spark, d), _wanted(spark, d), "/audio")


@query(f"""with {_BROKEN}, p as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) - 1 as i, l_quantity::double as q from lineitem)
  select k as article_id, i as part, voice, '/audio/k' || k || '/' || voice || i || '.mp3' as src, q as seconds from p, (values ('a'), ('b')) v(voice) where k not in (select k from b)""")
def manifest_assets(spark, d):
    return manifests.assets(_manifests(spark, d), _wanted(spark, d), "/audio")


@query("select distinct l_orderkey as article_id, l_orderkey % 11 <> 7 as ok from lineitem")
def manifest_playable(spark, d):
    return _manifests(spark, d).select("article_id", manifests.playable(F.col("parts"), F.col("voices")).alias("ok"))


@query("select case when l_linestatus = 'O' then 'recorded' else 'made' end as kind, count(*) as parts, sum(l_quantity::bigint)::bigint as seconds from (select *, l_linestatus as p from lineitem) group by 1")
def provider_kinds(spark, d):
    p = T.table(spark, d, "lineitem").select(F.col("l_linestatus").alias("provider"), F.col("l_quantity").cast("long").alias("seconds"))
    return manifests.provider_counts(p, ["O"])


@query("""with s as (select l_orderkey as article_id, sum(l_quantity::bigint)::bigint as sum from lineitem group by 1) select article_id, sum, sum + article_id % 3 as declared from s where article_id % 3 > 0""")
def seconds_declared(spark, d):
    p = T.recordings(spark, d).select("article_id", "seconds")
    declared = p.groupBy("article_id").agg(F.sum("seconds").alias("s")).select("article_id", (F.col("s") + F.col("article_id") % 3).alias("declared"))
    return manifests.off_by_more(p, declared)


@query("select count(*) as articles, count(*) filter (where o_orderstatus = 'F') as covered from (select distinct o_orderkey, o_orderstatus from orders)")
def coverage_count(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("article_id"), (F.col("o_orderstatus") == "F").alias("complete"))
    return manifests.covered(o.select("article_id").distinct(), o)


@query("""with m as (select distinct l_suppkey as c, l_linenumber as k from lineitem), f as (select c, k from m where not (c % 5 = 0 and k = 1))
  select c as candidate from f where c % 3 <> 0 and k <= 4 group by c having count(distinct k) = 4""")
def candidate_cache(spark, d):
    """Candidates that need no new synthesis: by fingerprint and by all their files."""
    li = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("candidate"), F.col("l_linenumber").cast("int").alias("case_id")).distinct()
    file = F.concat(F.lit("case-"), F.col("case_id").cast("string"))
    made = li.select("candidate", F.when(F.col("candidate") % 3 == 0, "old").otherwise("new").alias("made_fingerprint"), "case_id", file.alias("file"))
    files = li.where("not (candidate % 5 = 0 and case_id = 1)").select("candidate", file.alias("file"))
    candidates = li.select("candidate", F.lit("new").alias("fingerprint")).distinct()
    return manifests.cache_hits(candidates, spark.createDataFrame([(i,) for i in range(1, 5)], "case_id int"), made, files)


@query("""select conv_id as article_id, turn // 3 as part, row_number() over (partition by conv_id order by turn // 3, turn, role, coalesce(text, '')) - 1 as segment from conversations""")
def segment_numbers(spark, d):
    s = T.segments(spark, d).select("article_id", F.floor(F.col("ordinal") / 3).alias("part"), F.struct("ordinal", "type", "text").alias("pos"))
    return manifests.numbered_segments(s).select("article_id", "part", "segment")


@query("""select p_partkey as id, case when p_partkey % 10 = 0 then 'unknown' when p_partkey % 7 = 0 then 'skip' else 'take' end as state from part""")
def included_ids(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return manifests.chosen(p.where("id % 10 <> 0"), p, p.where("id % 7 = 0"))


@query("select n_name as voice from nation where n_nationkey not in (select s_nationkey from supplier where s_suppkey % 4 = 0)")
def voices_lacking(spark, d):
    n = T.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("voice"))
    have = T.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    return manifests.lacking(n, n.join(have, "n_nationkey", "left_semi"), "voice")


@query("""with r as (select l_linenumber as case_id, l_suppkey % 20 as code, l_quantity::int % 6 as score from lineitem), a as (select distinct case_id, code, (case_id * 7 + code) % 13 as candidate from r where code <> 3)
  select candidate, count(*) as ratings, count(distinct case_id) as cases from r join a using (case_id, code) where score between 1 and 5 group by candidate""")
def revealed_ratings(spark, d):
    """Blind codes looked up in the key by case and code; codes that the key lacks are dropped."""
    r = T.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("case_id"), (F.col("l_suppkey") % 20).alias("code"), (F.col("l_quantity").cast("int") % 6).alias("score"))
    key = r.where("code <> 3").select("case_id", "code", ((F.col("case_id") * 7 + F.col("code")) % 13).cast("long").alias("candidate")).distinct()
    return lab.revealed(r, key).where("score between 1 and 5").groupBy("candidate").agg(F.count("*").alias("ratings"), F.countDistinct("case_id").alias("cases"))


@query("""with s as (select conv_id as a, turn, role, coalesce(text, '') as t from conversations) select a as article_id, sha256('[' || string_agg('{"ordinal":' || turn || ',"type":"' || role || '"}', ',' order by turn, role, t) || ']') as snapshot from s group by a""")
def source_snapshots(spark, d):
    """A hash of an article's segments in order: what a recording was made from."""
    rows = T.segments(spark, d).groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "type", "text"))).alias("s"))
    return rows.select("article_id", F.sha2(F.to_json(F.transform("s", lambda x: F.struct(x["ordinal"].alias("ordinal"), x["type"].alias("type")))), 256).alias("snapshot"))
