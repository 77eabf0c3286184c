"""Queries on tables that change on disk and on files against plans, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.pictures import picture_size
from ..operators import assets, lab, stores
from ..shared import scratch
from ..sources import tables as T
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)


@query("select cast(o_orderkey % 6 as int) as run, o_orderstatus as status, count(*) as n, max(o_orderkey) as last from orders where o_orderkey % 6 >= 2 group by all")
def appended_ledger(spark, d):
    """Six runs of which the last four are kept; the third one is delivered twice."""
    o, root = T.table(spark, d, "orders"), scratch(spark)
    for k in (0, 1, 2, 3, 2, 4, 5):
        stores.append_run(o.where(F.col("o_orderkey") % 6 == k).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last")), root, f"{k:03}", 4)
    return spark.read.parquet(root).select(F.col("run").cast("int").alias("run"), "status", "n", "last")


@query("select p_partkey as id, cast((row_number() over (order by p_size, p_partkey) - 1) // 3 as int) as run from part qualify row_number() over (order by p_size, p_partkey) <= 12")
def rollout_steps(spark, d):
    """Four runs that complete three missing items each, the shortest first; the second one is repeated at the end."""
    wanted, root = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("requests")), scratch(spark)
    for k in (0, 1, 2, 3, 1):
        stores.complete_next(wanted, root, f"{k:03}", "id", ["requests"], 3)
    return spark.read.parquet(root).select("id", F.col("run").cast("int").alias("run"))


@query("""select s_suppkey as id, round(s_acctbal + case when s_suppkey % 3 = 0 then 1 else 0 end, 2) as balance from supplier
  union all select s_suppkey + 1000000, null from supplier where s_suppkey % 10 = 0""")
def upserted_balances(spark, d):
    """A table with a third of its rows replaced, some added, and some written as they were."""
    s, root = T.table(spark, d, "supplier"), scratch(spark)
    row = lambda rows, key, balance: rows.select(key.alias("id"), balance.cast("double").alias("balance"))
    k, b = F.col("s_suppkey"), F.round(F.col("s_acctbal"), 2)
    stores.upsert(row(s, k, b), root, "id", 16)
    stores.upsert(row(s.where(k % 3 == 0), k, F.round(F.col("s_acctbal") + 1, 2)).unionByName(row(s.where(k % 10 == 0), k + 1000000, F.lit(None))), root, "id", 16)
    stores.upsert(row(s.where(k % 3 == 1), k, b), root, "id", 16)
    return spark.read.parquet(root).select("id", "balance")


@query("""select 'current' as what, n_name as name from nation where n_regionkey = 1 union all select 'kept', n_name from nation where n_regionkey in (1, 2)""")
def released_nations(spark, d):
    """The release that a rollback has named, and all that are kept; a write that failed has left nothing."""
    n, root = T.table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_regionkey"), scratch(spark)
    for k in (1, 2):
        stores.publish(n.where(F.col("n_regionkey") == k).select("name"), root, f"r{k}")
    try:
        stores.publish(n.select(F.raise_error(F.lit("a failed write")).cast("string").alias("name")), root, "r3")
    except Exception as e:
        if "a failed write" not in str(e):
            raise
    stores.rollback(spark, root, "r1")
    named = lambda what, df: df.select(F.lit(what).alias("what"), "name")
    return named("current", stores.current(spark, root)).unionByName(named("kept", stores.retained(spark, root)))


def _little(n, size: int):
    """A number as hex digits, the least significant byte first."""
    return F.concat(*(F.lpad(F.hex(F.floor(n / 256**i).cast("long") % 256), 2, "0") for i in range(size)))


@query("""with p as (select doc_id as k, w, case when doc_id % 17 = 0 and w = 640 then doc_id || '.webp' else doc_id || '-' || w || '.webp' end as file, w + case when doc_id % 11 = 0 then 1 else 0 end as width, w * 9 // 16 - case when doc_id % 13 = 0 then 1 else 0 end as height
    from documents, (values (320), (640), (960), (1280)) v(w) where not (doc_id % 19 = 0 and w = 320))
  select file, case when k % 17 = 0 and w = 640 then 'name' else 'size' end as rule, case when k % 17 = 0 and w = 640 then '' else w || 'x' || w * 9 // 16 end as expected, case when k % 23 = 0 then '' else width || 'x' || height end as found from p
    where (k % 17 = 0 and w = 640) or width <> w or height <> w * 9 // 16 or k % 23 = 0
  union all select null, 'count', (select count(*) * 4 from documents)::varchar, (select count(*) from p)::varchar where (select count(*) * 4 from documents) <> (select count(*) from p)""")
def picture_sizes(spark, d):
    """Pictures as bytes of the three WebP forms, read back from their heads; some are of another size, are cut off, are
    named otherwise or missing."""
    docs, k, w = T.table(spark, d, "documents").select("doc_id"), F.col("doc_id"), F.col("w")
    made = docs.withColumn("w", F.explode(F.array(*map(F.lit, assets.WIDTHS)))).where(~((k % 19 == 0) & (w == 320)))
    width, height = w + F.when(k % 11 == 0, 1).otherwise(0), F.floor(w * 9 / 16) - F.when(k % 13 == 0, 1).otherwise(0)
    name = F.when((k % 17 == 0) & (w == 640), F.concat(k.cast("string"), F.lit(".webp"))).otherwise(F.concat_ws("", k.cast("string"), F.lit("-"), w.cast("string"), F.lit(".webp")))
    text = lambda s: F.lit(s.encode().hex())
    start = F.concat(text("RIFF"), F.lit("00000000"), text("WEBP"))
    lossy = F.concat(start, text("VP8 "), F.lit("00000000" + "000000" + "9d012a"), _little(width, 2), _little(height, 2))
    lossless = F.concat(start, text("VP8L"), F.lit("00000000" + "2f"), _little((width - 1) + (height - 1) * 16384, 4), F.lit("00" * 5))
    extended = F.concat(start, text("VP8X"), F.lit("00000000" + "00000000"), _little(width - 1, 3), _little(height - 1, 3))
    content = F.unhex(F.when(k % 3 == 0, lossy).when(k % 3 == 1, lossless).otherwise(extended))
    files = made.select(name.alias("file"), F.when(k % 23 == 0, F.substring(content, 1, 29)).otherwise(content).alias("content"))
    return assets.picture_failures(files.select("file", picture_size(F.col("content")).alias("s")).select("file", "s.*"), docs)


@query(r"""with f as (select doc_id as k, encode(coalesce(text, '')) as b, '/audio/articles/' || left(sha256((doc_id // 10)::varchar), 16) || '/' || doc_id || '.mp3' as path from documents),
  a as (select k // 10 as article_id, k % 10 as part, case when k % 31 = 0 then replace(path, '.mp3', '.wav') when k % 37 = 0 then replace(path, '/' || k, '/../' || k) else path end as src, octet_length(b) + case when k % 41 = 0 then 1 else 0 end as bytes,
    case when k % 43 = 0 then 'abc' when k % 47 = 0 then sha256('other') when k % 5 = 0 then null else sha256(b) end as sha, octet_length(b) / 1000 + case when k % 53 = 0 then 0.2 when k % 59 = 0 then 0.05 else 0 end as seconds, k from f
    union all select k // 10, 100 + k % 10, path, octet_length(b), sha256(b), octet_length(b) / 1000, k from f where k % 61 = 0),
  j as (select a.*, f.path is not null as there, octet_length(f.b) as size, sha256(f.b) as digest from a left join (select * from f where k % 29 <> 0) f on f.path = a.src),
  ok as (select *, src like '%.mp3' and not contains(src, '..') as safe from j),
  r as (select article_id, src, unnest(list_filter([case when not safe then 'unsafe_path' end, case when safe and not there then 'missing' end, case when there and size < 100 then 'too_small' end, case when there and size <> bytes then 'size' end,
    case when sha is not null and length(sha) <> 64 then 'hash_form' end, case when there and length(sha) = 64 and sha <> digest then 'hash' end, case when there and (seconds <= 0 or abs(size / 1000 - seconds) > 0.1) then 'seconds' end], lambda x: x is not null)) as rule from ok)
  select article_id, src, rule from r
  union all select article_id, src, 'duplicate' from a group by article_id, src having count(*) > 1
  union all select article_id, null, 'incomplete' from (select article_id, part, case when part = 3 and article_id % 2 = 0 then 'b' else 'a' end as voice from a) group by article_id having count(distinct (part, voice)) <> count(distinct part) * count(distinct voice)""")
def asset_failures(spark, d):
    """A manifest of recordings against the files: texts stand for the sound, thousands of bytes for seconds."""
    docs, k = T.table(spark, d, "documents"), F.col("doc_id")
    content = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    path = F.concat(F.lit("/audio/articles/"), assets.folder_key(F.floor(k / 10).cast("long")), F.lit("/"), k.cast("string"), F.lit(".mp3"))
    size, digest = F.octet_length(content).cast("long"), F.sha2(content, 256)
    files = docs.where(k % 29 != 0).select(path.alias("path"), size.alias("bytes"), digest.alias("sha256"), (size / 1000).alias("seconds"))
    src = F.when(k % 31 == 0, F.regexp_replace(path, r"\.mp3$", ".wav")).when(k % 37 == 0, F.regexp_replace(path, r"/(\d+\.mp3)$", "/../$1")).otherwise(path)
    said = F.when(k % 43 == 0, "abc").when(k % 47 == 0, F.sha2(F.lit("other"), 256)).when(k % 5 != 0, digest)
    longer = F.when(k % 53 == 0, 0.2).when(k % 59 == 0, 0.05).otherwise(0.0)
    article, part = F.floor(k / 10).cast("long"), (k % 10).cast("long")
    row = lambda rows, part, src, size, said, seconds: rows.select(article.alias("article_id"), part.alias("part"), F.when((part == 3) & (article % 2 == 0), "b").otherwise("a").alias("voice"), src.alias("src"), size.alias("bytes"), said.alias("sha256"), seconds.alias("seconds"))
    manifest = row(docs, part, src, size + F.when(k % 41 == 0, 1).otherwise(0), said, size / 1000 + longer)
    again = row(docs.where(k % 61 == 0), part + 100, path, size, digest, size / 1000)
    return assets.asset_failures(manifest.unionByName(again), files)


@query(r"""with s as (select conv_id as a, turn as g, coalesce(text, '') as t from conversations), c as (select distinct a * 100 + g as case_id, a, g from s where a % 5 = 0 union all select distinct a * 100 + 99, a, 9999 from s where a % 50 = 0),
  n as (select c.case_id, min(s.t) as t, count(s.a) as k from c left join s on s.a = c.a and s.g = c.g group by c.case_id),
  p as (select v as candidate, n.*, (v * 31 + case_id) as h from n, range(25) r(v)),
  i as (select candidate, case when h % 109 = 0 then -case_id - 1 else case_id end as case_id, case when h % 103 = 0 or h % 107 = 0 then 'x' else t end as said, case when h % 107 = 0 then sha256(t) end as sha, 1 + h % 95 as seconds from p, range(2) d(x) where h % 97 <> 0 and (x = 0 or h % 101 = 0)),
  u as (select i.*, n.t, n.k, n.case_id is not null as known from i left join n using (case_id))
  select null::bigint as candidate, case_id, 'no_segment' as rule, 1::bigint as n from n where k = 0
  union all select null, case_id, 'segment_not_unique', k from n where k > 1
  union all select candidate, case_id, 'unknown_case', 1 from u where not known
  union all select candidate, case_id, 'unknown_candidate', 1 from u where candidate = 24
  union all select candidate, case_id, 'doubled', count(*) from u where known and candidate < 24 group by candidate, case_id having count(*) > 1
  union all select candidate, null, 'incomplete', (select count(*) from n) - count(distinct case_id) filter (known) from u where candidate < 24 group by candidate having (select count(*) from n) > count(distinct case_id) filter (known)
  union all select candidate, case_id, 'other_text', 1 from u where k > 0 and not (coalesce(said = t, false) or coalesce(sha = sha256(t), false))
  union all select candidate, case_id, 'length', 1 from u where seconds < 2 or seconds > 90""")
def lab_integrity(spark, d):
    """Cases of a blind evaluation against the segments that they name, and what each candidate has recorded of them."""
    s = T.table(spark, d, "conversations").select(F.col("conv_id").alias("article_id"), F.col("turn").alias("segment_id"), F.coalesce("text", F.lit("")).alias("text"))
    a, g = F.col("article_id"), F.col("segment_id")
    cases = s.where(a % 5 == 0).select((a * 100 + g).alias("case_id"), a, g).distinct().unionByName(s.where(a % 50 == 0).select((a * 100 + 99).alias("case_id"), a, F.lit(9999).cast("long").alias("segment_id")).distinct())
    c, h = F.col("case_id"), F.col("candidate") * 31 + F.col("case_id")
    made = lab.canonical(cases, s).withColumn("candidate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(24).cast("long")))).where(h % 97 != 0)
    made = made.unionByName(made.where(h % 101 == 0))
    items = made.select(
        "candidate", F.when(h % 109 == 0, -c - 1).otherwise(c).alias("case_id"), F.when((h % 103 == 0) | (h % 107 == 0), "x").otherwise(F.col("text")).alias("text"),
        F.when(h % 107 == 0, F.sha2("text", 256)).alias("text_sha256"), (1 + h % 95).alias("seconds"))
    return lab.integrity(spark.range(24).select(F.col("id").alias("candidate")), cases, s, items)
