"""Queries on nested and dynamic values, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested, numbers, text
from ..operators import audit, routing, work
from ..sources import tables as T
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)

#: Answers of a speech service, by order number modulo 6: what comes before and after the number.
ANSWERS = [
    ('{"status":"done","steps":[{"type":"think","content":[{"type":"text","text":"t"}]},{"content":[{"type":"audio","data":"s', '"},{"type":"audio","data":"later"}]}]}'),
    ('{"outputs":[{"type":"text","text":"x"},{"content":[{"type":"audio","data":"o', '"}]}]}'),
    ("no json ", ""),
    ('{"output_audio":{"type":"audio","data":"a', '"}}'),
    ('{"steps":[],"outputs":[{"type":"audio","data":"flat', '"}]}'),
    ('{"status":"empty","steps":[{"type":"speak"}],"x":"', '"}'),
]
_ANSWER_SQL = "a as (select o_orderkey as id, case o_orderkey % 6 " + " ".join(f"when {i} then '{p}' || o_orderkey || '{q}'" for i, (p, q) in enumerate(ANSWERS)) + " end as j from orders), ok as (select id, case when json_valid(j) then j::json end as j from a)"


def _answers(spark, d):
    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    j = F.lit(None).cast("string")
    for i, (p, q) in enumerate(ANSWERS):
        j = F.when(F.col("id") % 6 == i, F.concat(F.lit(p), F.col("id").cast("string"), F.lit(q))).otherwise(j)
    return o.select("id", nested.parsed(j, nested.ANSWER).alias("answer"))


@query(f"""with {_ANSWER_SQL} select id, coalesce(
      list_filter(list_concat(coalesce(json_extract(j, '$.steps[*].content[*]'), []), coalesce(json_extract(j, '$.outputs[*]'), []), coalesce(json_extract(j, '$.outputs[*].content[*]'), [])),
        lambda x: x ->> 'type' = 'audio' and (x ->> 'data') is not null)[1] ->> 'data', j -> 'output_audio' ->> 'data') as data from ok""")
def answer_audio(spark, d):
    return _answers(spark, d).select("id", nested.answer_audio(F.col("answer"))["data"].alias("data"))


@query(f"""with {_ANSWER_SQL} select id, 'status=' || coalesce(j ->> 'status', 'unknown') || '; steps=' || coalesce(nullif(array_to_string(list_transform(json_extract(j, '$.steps[*]'), lambda x: coalesce(x ->> 'type', 'unknown')), ','), ''), 'none')
      || '; content=' || coalesce(nullif(array_to_string(list_transform(json_extract(j, '$.steps[*].content[*]'), lambda x: coalesce(x ->> 'type', 'unknown')), ','), ''), 'none') as line from ok""")
def answer_summary(spark, d):
    return _answers(spark, d).select("id", nested.answer_summary(F.col("answer")).alias("line"))


@query("""select l_orderkey as article_id, l_linenumber as line, l_partkey as part, l_suppkey as s,
      case when l_quantity::int % 3 = 0 then 'old-' || l_partkey when l_quantity::int % 3 = 1 then 'b-' || l_partkey end as src,
      case when l_quantity::int % 3 = 0 then l_quantity::bigint when l_quantity::int % 3 = 1 then l_quantity::bigint + 1 end as seconds from lineitem""")
def part_assets(spark, d):
    """Each part's sound for voice b: by the map of voices, or by the older field."""
    li, q = T.table(spark, d, "lineitem"), F.col("l_quantity").cast("int")
    one = lambda v, add: F.struct(F.concat(F.lit(f"{v}-"), F.col("l_partkey").cast("string")).alias("src"), (F.col("l_quantity").cast("long") + add).alias("seconds"))
    audio = F.when(q % 3 == 1, F.create_map(F.lit("a"), one("a", 0), F.lit("b"), one("b", 1))).when(q % 3 == 2, F.create_map(F.lit("a"), one("a", 0)))
    old = F.when(q % 3 == 0, one("old", 0))
    part = F.struct(audio.alias("audio"), old["src"].alias("src"), old["seconds"].alias("seconds"))
    found = nested.asset(part, F.lit("b"))
    return li.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s"), found["src"].alias("src"), found["seconds"].alias("seconds"))


@query("""with s as (select o_custkey as id, o_orderpriority as k, max(o_orderstatus) as v from orders group by all),
      m as (select id, map_from_entries(list({'key': k, 'value': v})) as m from s group by id)
      select id, coalesce(nullif(m['9-NONE'], ''), nullif(m['1-URGENT'], ''), nullif('', ''), 'common') as style, cardinality(m) as n from m""")
def default_style(spark, d):
    """A map from rows, and a value from it with two defaults behind: empty ones count as absent."""
    s = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("k")).agg(F.max("o_orderstatus").alias("v"))
    m = s.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    value = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("id", nested.first_set(value("9-NONE"), value("1-URGENT"), F.lit(""), F.lit("common")).alias("style"), F.size("m").cast("long").alias("n"))


_SETTINGS = "s as (select c_custkey as id, c_custkey % 3 as a, c_custkey % 5 as b, c_mktsegment as seg from customer)"


@query(f"""with {_SETTINGS} select id, case when b = 0 then 'process' else 'file' end as voice, case when a = 0 then '' else 'KEY' end ||
      case when seg in ('BUILDING', 'MACHINERY') then '' else case when a = 0 then '' else ',' end || 'REGION' end as missing from s""")
def settings_state(spark, d):
    """Settings of a file below those of the process, and the names that are still missing."""
    c = T.table(spark, d, "customer")
    key, seg = F.col("c_custkey"), F.col("c_mktsegment")
    local = F.create_map(F.lit("VOICE"), F.lit("file"), F.lit("KEY"), F.when(key % 3 == 0, "k").otherwise(""))
    own = F.create_map(F.lit("REGION"), F.when(seg.isin("BUILDING", "MACHINERY"), seg).otherwise(""))
    process = F.when(key % 5 == 0, F.map_concat(own, F.create_map(F.lit("VOICE"), F.lit("process")))).otherwise(own)
    merged = nested.merged_settings(local, process)
    return c.select(key.alias("id"), F.element_at(merged, F.lit("VOICE")).alias("voice"), F.array_join(nested.missing_settings(merged, ["KEY", "REGION"]), ",").alias("missing"))


@query("""with e as (select event_id, try_cast(props as json) ->> 'k' as k, value from events)
      select event_id, coalesce(try_cast(k as double), 0.0) as number, 'audio-voice-v1:' || case when event_id % 4 = 0 then 'default' else 'some-voice-' || event_id % 9 end as pref,
        printf('%s-part-%03d-%s.mp3', 'v' || event_id % 3, event_id % 1000, left(md5(cast(event_id as varchar)), 8)) as file,
        (event_id % 32) * 9 = 18 * 16 as wide, greatest(0, least(100, cast(floor((value - 10) / 50 * 100 + 0.5) as bigint))) as percent,
        case when event_id % 2 = 0 then 'a b' || event_id else 'x%zz' || event_id end as decoded, case when event_id % 7 = 0 then 'a&lt;b&#39;&amp;' else 'plain' end as html from events join e using (event_id, value)""")
def small_values(spark, d):
    """Scalar rules: numbers from JSON, keys, names of files, sizes, progress, decoding, escaping."""
    e, i = T.table(spark, d, "events"), F.col("event_id")
    number = nested.safe_number(nested.parsed(F.col("props"), "k string")["k"])
    provider = F.when(i % 4 != 0, F.concat(F.lit("Some  voICE_"), (i % 9).cast("string")))
    return e.select(
        "event_id", number.alias("number"), nested.preference_key(provider).alias("pref"),
        nested.part_file(F.concat(F.lit("v"), (i % 3).cast("string")), (i % 1000).cast("int"), F.md5(i.cast("string"))).alias("file"),
        nested.wide(i % 32, F.lit(18)).alias("wide"), nested.read_percent(F.col("value"), F.lit(10), F.lit(50)).alias("percent"),
        nested.decoded(F.when(i % 2 == 0, F.concat(F.lit("a%20b"), i.cast("string"))).otherwise(F.concat(F.lit("x%zz"), i.cast("string")))).alias("decoded"),
        nested.escape_html(F.when(i % 7 == 0, "a<b'&").otherwise("plain")).alias("html"))


@query("""select s_suppkey as id, case s_suppkey % 3 when 0 then '494433AB' when 1 then 'FFFB9000' end as head from supplier""")
def sound_heads(spark, d):
    """base64 to bytes, only where these begin as sound does."""
    i = F.col("s_suppkey")
    data = F.when(i % 3 == 0, F.base64(F.unhex(F.lit("494433AB")))).when(i % 3 == 1, F.base64(F.unhex(F.lit("FFFB9000")))).otherwise(F.when(i % 2 == 0, "***").otherwise(F.base64(F.lit("text").cast("binary"))))
    return T.table(spark, d, "supplier").select(i.alias("id"), F.hex(nested.sound_bytes(data)).alias("head"))


@query("""select p_partkey as id, case when p_partkey % 4 = 0 then '["a<b","' || p_type || '"]' else '[]' end as shown, case when p_partkey % 4 = 0 then 2 else 0 end as n,
      '<speak version="1.0" xml:lang="ar"><voice name="' || p_brand || '">' || replace(p_name, ' ', ' &amp; ') || '</voice></speak>' as ssml from part""")
def escaped_lists(spark, d):
    """Lists from JSON, the empty list where there is none, and requests for speech."""
    i = F.col("p_partkey")
    json = F.when(i % 4 == 0, F.concat(F.lit('["a<b","'), F.col("p_type"), F.lit('"]'))).when(i % 4 == 1, "{}").when(i % 4 == 2, "no list")
    got = nested.parsed_list(json)
    return T.table(spark, d, "part").select(
        i.alias("id"), F.replace(nested.escaped_json(got), F.lit("\\u003c"), F.lit("<")).alias("shown"), F.size(got).cast("long").alias("n"),
        nested.ssml("ar", F.col("p_brand"), F.replace(F.col("p_name"), F.lit(" "), F.lit(" & "))).alias("ssml"))


@query("""select n_nationkey as id, case when length('Nation number ' || n_nationkey || ' of the atlas, with its people and its rivers') > 54 then rtrim(left('Nation number ' || n_nationkey || ' of the atlas, with its people and its rivers', 51)) || '…' else 'Nation number ' || n_nationkey || ' of the atlas, with its people and its rivers' end as crumb,
      case when 5 * (20 + n_nationkey) - 1 > 160 then rtrim(left(repeat('word ', 20 + n_nationkey), 157)) || '…' else rtrim(repeat('word ', 20 + n_nationkey)) end as description from nation""")
def shortened_texts(spark, d):
    """Titles of a trail and descriptions, cut to their longest."""
    i = F.col("n_nationkey")
    title = F.concat(F.lit("Nation number "), i.cast("string"), F.lit(" of the atlas, with its people and its rivers"))
    return T.table(spark, d, "nation").select(i.alias("id"), text.crumb(title).alias("crumb"), text.meta_description(F.repeat(F.lit("word  "), F.lit(20) + i.cast("int"))).alias("description"))


@query("""select event_id, coalesce(event_id % 4 < 3 and value - 1 >= 0 and (event_id % 50 - 1) * 86400000 between 0 and 2592000000, false) as ok from events""")
def saved_progress(spark, d):
    """Saved positions that may be used: in range, not from the future, not too old."""
    i = F.col("event_id")
    now = F.lit(1_700_000_000_000)
    ok = numbers.valid_progress(i % 4, F.lit(3), F.col("value") - 1, now - (i % 50 - 1) * 86_400_000, now)
    return T.table(spark, d, "events").select("event_id", ok.alias("ok"))


@query("""select p_partkey as id, case when p_partkey % 3 = 0 then 'x-a=1,x-robots-tag=noindex, nofollow' when p_partkey % 2 = 0 then 'x-a=1' else 'access-control-allow-origin=*,x-a=1' end
      || case when p_partkey % 3 = 0 and p_partkey % 2 = 1 then ',access-control-allow-origin=*' else '' end as headers from part""")
def header_rules(spark, d):
    """Headers by host and content: previews are not indexed, pages lose the origin header."""
    i = F.col("p_partkey")
    given = F.create_map(F.lit("access-control-allow-origin"), F.lit("*"), F.lit("x-a"), F.lit("1"), F.lit("x-robots-tag"), F.lit("index"))
    got = routing.response_headers(F.when(i % 3 == 0, "a.preview.test").otherwise("a.org"), F.when(i % 2 == 0, "text/html; charset=utf-8").otherwise("image/png"), given, ".preview.test")
    entries = F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    preview = F.concat(F.filter(entries, lambda e: ~e.startswith("access")), F.filter(entries, lambda e: e.startswith("access")))
    return T.table(spark, d, "part").select(i.alias("id"), F.array_join(F.when(i % 3 == 0, preview).otherwise(entries), ",").alias("headers"))


@query("select p_partkey as id, case when p_partkey % 2 = 0 then 'only_left' else 'only_right' end as side from part where (p_partkey % 2 = 0) <> (p_partkey % 3 = 0)")
def differing_sets(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return work.symmetric_difference(p.where("id % 2 = 0"), p.where("id % 3 = 0"), "id")


@query("select p_partkey as id, case when p_partkey % 4 = 0 then null else p_name end as name from part where p_partkey % 4 = 0 or p_partkey % 5 = 0")
def changed_rows(spark, d):
    """Rows that are new or differ, null included."""
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    after = p.withColumn("name", F.when(F.col("id") % 4 != 0, F.col("name")))
    return work.changed_only(p.where("id % 5 <> 0"), after, "id")


@query("""select event_id, case when value - 20 < 0 then '' else (floor(value - 20)::bigint // 60)::varchar || ':' || lpad((floor(value - 20)::bigint % 60)::varchar, 2, '0') end as clock,
      case event_id % 40 when 0 then 'لا مقالات منشورة' when 1 then 'مقال واحد' when 2 then 'مقالان' else translate((event_id % 40)::varchar, '0123456789', '٠١٢٣٤٥٦٧٨٩') || case when event_id % 40 <= 10 then ' مقالات' else ' مقالًا' end end as label from events""")
def clock_labels(spark, d):
    i = F.col("event_id")
    return T.table(spark, d, "events").select("event_id", numbers.clock(F.col("value") - 20).alias("clock"), text.article_count_label(i % 40).alias("label"))


@query("""with a as (select p_partkey as id, case when p_partkey % 2 = 0 then p_name end as title, repeat('d', (p_partkey % 60)::int) as description, case when p_partkey % 3 <> 0 then p_brand end as category, p_type as series, p_size - 5 as width,
        list_value('a', 'b', 'c')[1 : (p_partkey % 4)::int] as tags, case when p_partkey % 5 = 0 then repeat('s', (p_partkey % 70)::int) end as summary from part),
      r as (select id, unnest([case when title is null or title = '' then 'title' end, case when length(description) < 40 then 'description' end, case when category is null or category not in ('Brand#1', 'Brand#2', 'Brand#17') then 'category' end,
        case when series <> 'ECONOMY' then 'series' end, case when len(tags) > 2 then 'tags' end, case when width <= 0 then 'size' end, case when length(summary) < 50 then 'summary' end]) as rule from a) select * from r where rule is not null""")
def schema_rules(spark, d):
    """Articles whose head breaks the schema: one row for each rule."""
    i = F.col("p_partkey")
    a = T.table(spark, d, "part").select(
        i.alias("id"), F.when(i % 2 == 0, F.col("p_name")).alias("title"), F.repeat(F.lit("d"), (i % 60).cast("int")).alias("description"), F.when(i % 3 != 0, F.col("p_brand")).alias("category"), F.col("p_type").alias("series"),
        (F.col("p_size") - 5).alias("width"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (i % 4).cast("int")).alias("tags"), F.when(i % 5 == 0, F.repeat(F.lit("s"), (i % 70).cast("int"))).alias("summary"))
    return audit.schema_rules(a, ["Brand#1", "Brand#2", "Brand#17"], ["ECONOMY"])
