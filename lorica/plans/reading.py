"""Queries on narration, work and readers, each with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import audit, feed, lab, speech, work
from ..sources import tables as T
from ..streaming import state
from .oracle import _POSTS
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)


def _published(spark, d):
    return feed.published(T.posts(spark, d))


@query(r"""with s as (select conv_id as a, turn // 4 as part, turn, role, coalesce(text, '') as t from conversations),
  w as (select *, greatest(220, len(list_filter(string_split_regex(t, '\s+'), lambda x: x <> '')) * 220 + length(regexp_replace(t, '\s', '', 'g')) * 10 + len(regexp_extract_all(t, '[.!؟]')) * 242 + len(regexp_extract_all(t, '[،؛:]')) * 99) as g from s),
  u as (select *, sum(g) over o as upto, sum(g) over (partition by a, part) as every, case when lag(role) over o is not distinct from role and row_number() over o > 1 then 0 else 1 end as new from w window o as (partition by a, part order by turn, role, t rows unbounded preceding)),
  r as (select *, sum(new) over (partition by a, part order by turn, role, t rows unbounded preceding) as run from u)
  select a as article_id, part, run::bigint as run, role as id, min(floor((upto - g) * 1000000 / every))::bigint as "start", max(floor(upto * 1000000 / every))::bigint as "end" from r group by a, part, run, role""")
def weighted_intervals(spark, d):
    s = T.segments(spark, d)
    pieces = s.select("article_id", F.floor(F.col("ordinal") / 4).alias("part"), F.struct("ordinal", "type", "text").alias("pos"), F.col("type").alias("id"), "text")
    return speech.weighted_intervals(pieces)


@query()
def audio_parts(spark, d):
    """Whole narrations: titles first, pieces of at most 120 bytes, parts of at most 400; held by a loop in the tests."""
    s = T.segments(spark, d)
    name = F.format_string("b%04d", F.row_number().over(Window.partitionBy("article_id").orderBy(*speech.IN_ORDER)))
    cut = speech.chunked(s.withColumn("type", F.concat_ws("|", name, "type")), 120)
    pieces = cut.select("article_id", F.struct("ordinal", "type", "piece").alias("k"), F.element_at(F.split("type", r"\|"), 1).alias("id"), F.element_at(F.split("type", r"\|"), 2).alias("type"), F.left("text", F.lit(20)).alias("match"), "text")
    pieces = pieces.withColumn("pos", F.row_number().over(Window.partitionBy("article_id").orderBy("k"))).drop("k")
    titles = s.select("article_id").distinct().withColumn("title", F.concat(F.lit("Talk "), F.col("article_id").cast("string")))
    return speech.audio_parts(titles, pieces, 400)


@query("""with e as (select user_id, event_type, ts, event_id from events), k as (select user_id, count(*) filter (where event_type = 'purchase') as n, arg_max(event_type, (ts, event_id)) as last from e group by user_id)
  select user_id, n % 3 as part, n // 3 as runs, n > 0 and n % 3 = 0 and last = 'purchase' as finished from k""")
def player_state(spark, d):
    e = T.reader_events(spark, d)
    return state.playback(e.withColumn("kind", F.when(F.col("event_type") == "purchase", "ended").otherwise(F.col("event_type"))), "user_id", 3)


@query("""with n as (select user_id, ts from events where event_type = 'click'), e as (select user_id, ts, event_id from events where event_type = 'view'),
  l as (select event_id, e.ts, max(n.ts) as last from e left join n on n.user_id = e.user_id and n.ts <= e.ts group by event_id, e.ts) select event_id from l where last is null or epoch_us(ts) - epoch_us(last) >= 3600000000""")
def unsuppressed_events(spark, d):
    e = T.reader_events(spark, d)
    return state.unsuppressed(e.where("event_type = 'view'"), e.where("event_type = 'click'").select("user_id", "ts"), "user_id", 3600.0)


@query(f"""with {_POSTS} select id, translate(cast(day(published_at) as varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' ' || ['يناير', 'فبراير', 'مارس', 'أبريل', 'مايو', 'يونيو', 'يوليو', 'أغسطس', 'سبتمبر', 'أكتوبر', 'نوفمبر', 'ديسمبر'][month(published_at)]
  || ' ' || translate(cast(year(published_at) as varchar), '0123456789', '٠١٢٣٤٥٦٧٨٩') as day, '/images/generated/p' || id || '-640.webp' as src from posts""")
def arabic_dates(spark, d):
    picture = text.image_set(F.concat(F.lit("/images/posts/p"), F.col("id").cast("string"), F.lit(".jpg")))
    return _published(spark, d).select("id", numbers.arabic_date(F.col("published_at")).alias("day"), picture["src"].alias("src"))


@query(f"""with {_POSTS}, m as (select * from (values ('en', 'English'), ('de', 'Deutsch')) t(slug, label)) select id, coalesce(label, 'other') as label from posts left join m on category_slug = slug""")
def category_labels(spark, d):
    """Each article with the label of its category, by a short list that need not have it."""
    labels = spark.createDataFrame([("en", "English"), ("de", "Deutsch")], "category_slug string, label string")
    return _published(spark, d).join(audit.bounded(labels), "category_slug", "left").select("id", F.coalesce("label", F.lit("other")).alias("label"))


@query(f"with {_POSTS} select distinct unnest(tags) as tag from posts")
def distinct_tags(spark, d):
    return _published(spark, d).select(F.explode("tags").alias("tag")).distinct().orderBy(F.collate("tag", "ar"))


@query("select count(distinct (conv_id, turn, role, text)) as n_distinct, count(*) as segments, sum(length(coalesce(text, '')))::bigint as characters, sum(octet_length(encode(coalesce(text, ''))))::bigint as bytes from conversations")
def narration_totals(spark, d):
    c = T.table(spark, d, "conversations")
    said = F.coalesce("text", F.lit(""))
    return c.agg(F.countDistinct(F.struct("conv_id", "turn", "role", "text")).alias("n_distinct"), F.count("*").alias("segments"), F.sum(F.char_length(said)).alias("characters"), F.sum(F.octet_length(said)).alias("bytes"))


@query("select p_partkey as candidate, k as case_id from part, (values (1), (2), (3)) v(k) where not (p_partkey % 2 = 0 or k = p_partkey % 5)")
def incomplete_cases(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("candidate"))
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id int")
    done = p.crossJoin(F.broadcast(cases)).where("candidate % 2 = 0 or case_id = candidate % 5")
    return work.incomplete(p, cases, done)


@query("""with l as (select s_suppkey as list_id, unnest([s_suppkey % 30, 3, s_suppkey % 7 + 20]) as id, unnest([0, 1, 2]) as pos from supplier) select list_id, pos, id, id not in (select n_nationkey from nation) as missing from l""")
def ordered_lists(spark, d):
    """Lists of ids spelled out in their order, with what is not there."""
    s, k = T.table(spark, d, "supplier"), F.col("s_suppkey")
    lists = s.select(k.alias("list_id"), F.array(k % 30, F.lit(3), k % 7 + 20).alias("ids"))
    return work.in_list_order(lists, T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))).select("list_id", "pos", "id", "missing")


@query("""with p as (select l_orderkey as a, l_linenumber as i, l_quantity::double as q, l_suppkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as pos from lineitem)
  select a as article_id, pos from p where pos % 3 = 1 or (pos = 2 and a % 2 = 0) union all select distinct a, 90 from p where a % 5 = 0""")
def parts_that_differ(spark, d):
    """Two lists of parts side by side, by place: missing on one side, or further apart than a tenth of a second."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    p = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), (F.row_number().over(w) - 1).alias("pos"), F.col("l_quantity").cast("double").alias("seconds"))
    found = p.where("pos % 3 <> 1").withColumn("seconds", F.col("seconds") + F.when((F.col("pos") == 2) & (F.col("article_id") % 2 == 0), 0.2).otherwise(0.05))
    extra = p.where("article_id % 5 = 0").select("article_id", F.lit(90).alias("pos"), F.lit(1.0).alias("seconds")).distinct()
    return work.positional_gaps(p, found.unionByName(extra), 0.1).select("article_id", "pos")


@query("""with r as (select l_orderkey as a, l_linenumber as pos, case when l_linenumber = 1 then '' when l_orderkey % 4 = 0 and l_linenumber > 4 then 'other' else 'one' end as p from lineitem)
  select a as article_id, case when bool_or(p <> '') then arg_min(p, pos) filter (where p <> '') end as provider, count(distinct p) filter (where p <> '') <= 1 as consistent from r group by a""")
def one_provider(spark, d):
    li = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("pos"))
    named = F.when(F.col("pos") == 1, "").when((F.col("article_id") % 4 == 0) & (F.col("pos") > 4), "other").otherwise("one")
    return work.unique_provider(li.withColumn("provider", named))


@query("""with i as (select l_orderkey as article_id, l_linenumber as ordinal, l_quantity::bigint as s, l_quantity::bigint + case when l_suppkey % 9 = 0 then -1 else 1 end as e, l_suppkey, l_partkey from lineitem),
  o as (select *, lag(s) over (partition by article_id order by ordinal, l_partkey, l_suppkey) as before from i) select article_id, ordinal, l_partkey as part from o where s < before or e < s""")
def backward_intervals(spark, d):
    i = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("ordinal"), F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity").cast("long") + F.when(F.col("l_suppkey") % 9 == 0, -1).otherwise(1)).alias("end"), F.col("l_partkey").alias("type"), F.col("l_suppkey").alias("text"))
    return audit.unmonotonic(i).select("article_id", "ordinal", F.col("type").alias("part"))


@query("select o_orderkey as run from orders order by o_orderkey desc limit 100")
def ledger_view(spark, d):
    return work.latest_runs(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_orderkey").alias("seq"))).select("run")


@query(f"""with {_POSTS}, o as (select id, 'old' as phrase from posts where id % 2 = 0), n as (select id, left(body, 3) as phrase from posts where id % 3 = 0),
  m as (select * from o where id not in (select id from n) union all select * from n) select id as article_id, sha256(body) as body_hash, case when contains(body, phrase) then 1 else 0 end as n from m join posts using (id) where body is not null""")
def kept_reviews(spark, d):
    """Reviews replaced by newer ones of the same article, with the checks whose phrase the text still has."""
    p = _published(spark, d).where("body is not null")
    made = lambda rows, phrase: rows.select(F.col("id").alias("article_id"), F.lit("").alias("body_hash"), F.array(F.struct(phrase.alias("from"), F.lit("x").alias("to"))).alias("checks"))
    merged = work.merged_rules(made(p.where("id % 2 = 0"), F.lit("old")), made(p.where("id % 3 = 0"), F.left("body", F.lit(3))))
    return work.kept_checks(merged, p).select("article_id", "body_hash", F.size("checks").alias("n"))


@query("""with r as (select p_partkey as a, 'f' || p_partkey % 3 as f, 'old' as t from part where p_partkey % 2 = 0), w as (select p_partkey as a, f, 'new' as t from part, (values ('f0'), ('f1')) v(f))
  select a as article_id, f as "from", t as "to" from r union all select a, f, t from w where (a, f) not in (select a, f from r)""")
def appended_rules(spark, d):
    p, k = T.table(spark, d, "part"), F.col("p_partkey")
    rules = p.where("p_partkey % 2 = 0").select(k.alias("article_id"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("from"), F.lit("old").alias("to"))
    wanted = p.select(k.alias("article_id"), F.explode(F.array(F.lit("f0"), F.lit("f1"))).alias("from"), F.lit("new").alias("to"))
    return work.with_missing_rules(rules, wanted)


@query("select n_nationkey as id, case when n_nationkey % 2 = 0 then 'a long a' when n_nationkey % 3 = 0 then 'own rules' else 'a long a' end as said from nation")
def spoken_rules(spark, d):
    """Common rules and those of one article, applied longest first."""
    rule = lambda a, b: F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"))
    k = F.col("n_nationkey")
    own = F.when((k % 2 != 0) & (k % 3 == 0), F.array(rule("ab cd ab", "own rules")))
    said = text.spoken(F.lit("ab cd ab"), work.all_rules(F.array(rule("ab", "a"), rule(" cd ", " long ")), own))
    return T.table(spark, d, "nation").select(k.alias("id"), said.alias("said"))


@query("select s_suppkey as candidate from supplier where s_suppkey % 4 <> 1")
def enabled_candidates(spark, d):
    k = F.col("s_suppkey")
    return lab.enabled(T.table(spark, d, "supplier").select(k.alias("candidate"), F.when(k % 4 == 1, False).when(k % 4 == 2, True).alias("enabled"))).select("candidate")


@query("select n_nationkey as id, n_name as name from nation where n_nationkey = 7")
def point_lookup(spark, d):
    return work.found_or_error(T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "id", 7)


@query("""with k as (select 'whole' as what, n_nationkey as id from nation union all select 'short', n_nationkey from nation where n_nationkey % 6 <> 0 union all select 'doubled', s_nationkey from supplier)
  select what, count(distinct id) as distinct_ids, count(*) as n, count(distinct id) = 25 and count(*) = 25 as ok from k group by what""")
def exact_set(spark, d):
    """Three lists of ids of which one is the exact set of 25."""
    n, s = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), T.table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"))
    lists = {"whole": n, "short": n.where("id % 6 <> 0"), "doubled": s}
    return audit.union(*(work.exactly(ids, "id", 25).select(F.lit(what).alias("what"), "distinct_ids", "n", "ok") for what, ids in lists.items()))


@query("with f as (select p_partkey as subject, 'size' as rule from part where p_size > 10) select * from f order by subject, rule limit 150")
def failure_report(spark, d):
    p = T.table(spark, d, "part").where("p_size > 10")
    return audit.report(p.select(F.col("p_partkey").alias("subject"), F.lit("size").alias("rule")))
