"""DuckDB SQL for the queries of queries.py that SQL can express."""

_POSTS = r"""posts as (
  select doc_id as id, substring(text, 1, 60) as title, text as body, lang as category_slug, source as series_slug,
    coalesce(quality, 0) = 1 as featured, timestamp '2024-01-01' + to_hours(doc_id) as published_at,
    case when doc_id % 3 = 0 then timestamp '2024-01-01' + to_hours(doc_id) + to_days(cast(doc_id % 5 + 1 as int)) end as updated_at,
    ['t' || (doc_id % 7), 't' || (doc_id % 11)] as tags
  from documents left join (select doc_id, max(toxic) as toxic, max(quality) as quality from labels group by doc_id) using (doc_id)
  where coalesce(toxic, 0) <> 1),
categories as (select distinct lang as slug from documents union all select 'unused')"""
_SEG = "seg as (select conv_id as article_id, turn as ordinal, role as type, coalesce(text, '') as text from conversations)"
_SYNC = rf"""{_SEG},
w as (select *, greatest(1, length(text)) as weight from seg),
u as (select *, sum(weight) over (partition by article_id order by ordinal, type, text rows unbounded preceding) as upto, sum(weight) over (partition by article_id) as every from w),
sync as (select article_id, ordinal, type, text, cast(floor((upto - weight) * 1000000 / every) as bigint) as "start", cast(floor(upto * 1000000 / every) as bigint) as "end" from u)"""
_REC = """rec as (select l_orderkey as article_id, cast(l_quantity as bigint) as seconds,
  row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, cast(l_quantity as bigint)) - 1 as part,
  sum(cast(l_quantity as bigint)) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, cast(l_quantity as bigint) rows unbounded preceding) as upto,
  sum(cast(l_quantity as bigint)) over (partition by l_orderkey) as total from lineitem)"""
_WANTED = f"""{_SEG}, wanted as (select article_id, count(*) as requests, sum(length(text)) as characters from seg group by article_id)"""
_PLAIN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(BODY, '!\[([^\]]*)\]\([^)]+\)', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), 'https?://\S+', ' ', 'g'), '<[^>]+>|[`*_>#\[\]()|~!-]', ' ', 'g'), '\s+', ' ', 'g')"""
_HREF = r"""regexp_extract_all(html, '\b(?:href|src|data-src)=["'']([^"'']+)["'']', 1)"""
_PATH = r"""(case when regexp_replace(regexp_replace(X, '^[a-z]+://[^/]+', ''), '[?#].*$', '') = '' then '/' else
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(X, '^[a-z]+://[^/]+', ''), '[?#].*$', ''), '/index\.html$', '/'), '\.html$', '') end)"""


def _path(x: str) -> str:
    return _PATH.replace("X", x)


def _literal(rows: list[tuple], names: str) -> str:
    one = lambda v: "null" if v is None else repr(v) if not isinstance(v, str) else "'" + v + "'"
    return f"(values {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) as t({names})"


_DAY = "strftime({}, '%Y-%m-%d')"

ORACLE: dict[str, str] = {
    "published_feed": f"with {_POSTS} select id, category_slug, strftime(published_at, '%Y-%m-%dT%H:%M:%S.000Z') as published, featured from posts",
    "latest_20": f"with {_POSTS} select id from posts order by published_at desc, id limit 20",
    "latest_per_category_top3": f"""with {_POSTS},
      r as (select *, row_number() over (partition by category_slug order by published_at desc, id) as rn from posts)
      select slug, count(id) as articles, coalesce(string_agg(cast(id as varchar), ',' order by rn) filter (where rn <= 3), '') as newest
      from categories left join r on r.category_slug = slug group by slug""",
    "category_lastmod_with_empty": f"with {_POSTS} select slug, {_DAY.format('max(coalesce(updated_at, published_at))')} as lastmod from categories left join posts on category_slug = slug group by slug",
    "tag_index_counts": f"with {_POSTS}, t as (select distinct id, unnest(tags) as tag from posts) select tag, count(*) as articles from t group by tag",
    "tag_index_threshold": f"with {_POSTS}, t as (select distinct id, unnest(tags) as tag from posts where featured) select tag, count(*) as articles, row_number() over (order by tag collate ar) as place from t group by tag having count(*) >= 3",
    "series_counts": f"with {_POSTS} select series_slug, count(*) as articles from posts where series_slug is not null group by series_slug having count(*) >= 2",
    "series_ordered": f"""with {_POSTS}, o as (select * from {_literal([("src1", 41, 1), ("src1", 1, 2), ("src2", 22, 1)], "s, i, place")})
      select series_slug, id, row_number() over (partition by series_slug order by place is null, place, published_at, id) as position
      from posts left join o on s = series_slug and i = id where series_slug is not null""",
    "signature_or_latest": f"""with {_POSTS}, c as (select * from {_literal([("en", 5), ("de", -1), ("fr", 6)], "cat, chosen")})
      select cat as category_slug, coalesce((select id from posts where id = chosen), (select id from posts where category_slug = cat order by published_at desc, id limit 1)) as id from c""",
    "related_top3": f"""with {_POSTS},
      pairs as (select p.id, c.id as candidate, c.published_at, coalesce(p.series_slug = c.series_slug, false) as same_series,
        len(list_filter(c.tags, lambda t: list_contains(p.tags, t))) as shared, coalesce(p.category_slug = c.category_slug, false) as same_category
        from posts p join posts c on p.id <> c.id),
      s as (select *, case when same_series or shared > 0 then 1 when same_category then 2 else 3 end as tier,
        case when same_series or shared > 0 then 8 * same_series::int + 3 * shared + same_category::int else 0 end as score from pairs),
      r as (select *, row_number() over (partition by id order by tier, score desc, published_at desc, candidate) as position from s)
      select id, candidate, position from r where position <= 3""",
    "prev_next": f"with {_POSTS} select id, lag(id) over (order by published_at desc, id) as newer, lead(id) over (order by published_at desc, id) as older from posts",
    "home_slots": f"""with {_POSTS},
      h as (select id from posts order by published_at desc, id limit 1),
      b as (select id from posts where category_slug = 'de' and id not in (select id from h) order by published_at desc, id limit 1),
      r as (select id, row_number() over (order by published_at desc, id) as k from posts where id not in (select id from h union select id from b)),
      n as (select count(*) as n from r)
      select id, 'hero' as slot, 1 as position from h union all select id, 'book', 1 from b
      union all select id, case when k <= 3 then 'side' when k <= 9 then 'latest' else 'picks' end,
        case when k <= 3 then k when k <= 9 then k - 3 else k - 9 end from r, n where k <= 9 or (k <= 12 and n >= 12)""",
    "sitemap_urls": f"""with {_POSTS}, p as (select *, coalesce(updated_at, published_at) as c from posts),
      t as (select distinct id, unnest(tags) as tag, c from p)
      select path, {_DAY.format('m')} as lastmod from (select max(c) as m from p), (values ('/'), ('/articles/'), ('/start-here/'), ('/series/')) v(path)
      union all select '/category/' || slug || '/', {_DAY.format('max(c)')} from categories left join p on category_slug = slug group by slug
      union all select '/series/' || series_slug || '/', {_DAY.format('max(c)')} from p where series_slug is not null group by series_slug having count(*) >= 2
      union all select '/tags/' || tag || '/', {_DAY.format('max(c)')} from t group by tag having count(*) >= 3
      union all select '/posts/' || id || '/', {_DAY.format('c')} from p""",
    "rss_items": f"""with {_POSTS} select id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') as title,
      'https://example.org/posts/' || id || '/' as link, strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') as pub_date, category_slug as category from posts""",
    "reading_minutes": f"""with {_POSTS}, w as (select id, len(list_filter(string_split_regex({_PLAIN.replace('BODY', 'body')}, ' '), lambda x: x <> '')) as words from posts)
      select id, words, cast(greatest(1, ceil(words / 170.0)) as bigint) as minutes from w""",
    "search_excerpt": f"with {_POSTS} select id, left(trim({_PLAIN.replace('BODY', 'body')}), 420) as excerpt from posts",
    "search_ascii": f"with {_POSTS} select id from posts where contains(lower(title), 'the')",
    "link_integrity": f"""with l as (select distinct page_id, unnest({_HREF}) as target from pages),
      w as (select * from l where starts_with(target, '/') and not starts_with(target, '//')),
      there as (select distinct {_path('url')} as path from pages)
      select page_id, target from w where {_path("regexp_replace(target, '[?#].*$', '')")} not in (select path from there)
        and {_path("regexp_replace(target, '[?#].*$', '')")} || '/' not in (select path from there)""",
    "duplicate_titles": r"""with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '&(?:amp|quot|#39|lt|gt);', ' ', 'g'), '\s+', ' ', 'g')) as title from pages)
      select title, count(*) as pages, min(page_id) as first_page from t where title <> '' group by title having count(*) > 1""",
    "redirect_routing": f"""with r as (select distinct {_path('url')} as path from pages)
      select path, case when path = '/old' then '/new' when starts_with(path, '/p/') then '/pages/' when starts_with(path, '/') then '/404' end as target,
        case when path = '/old' then 301 when starts_with(path, '/p/') then 302 when starts_with(path, '/') then 404 end as status from r""",
    "pack_numeric": f"""with recursive {_SEG},
      n as (select *, octet_length(encode(text)) as b, row_number() over (partition by article_id order by ordinal, type, octet_length(encode(text)), text) as k from
        (select article_id, ordinal, type, text from seg)),
      o as (select article_id, b, row_number() over (partition by article_id order by ordinal, type, text) as k from n),
      f as (select article_id, k, b as used, 1 as part from o where k = 1
        union all select o.article_id, o.k, case when f.used > 0 and f.used + o.b > 400 then o.b else f.used + o.b end, f.part + case when f.used > 0 and f.used + o.b > 400 then 1 else 0 end
        from f join o on o.article_id = f.article_id and o.k = f.k + 1)
      select article_id, max(part) as parts, (select sum(b) from o where o.article_id = f.article_id) as bytes from f group by article_id""",
    "sync_intervals": f"with {_SYNC} select * from sync",
    "sync_merge_islands": f"""with {_SYNC}, n as (select *, case when lag(type) over w is not distinct from type then 0 else 1 end as new from sync window w as (partition by article_id order by ordinal, type, text)),
      r as (select *, cast(sum(new) over (partition by article_id order by ordinal, type, text rows unbounded preceding) as bigint) as run from n)
      select article_id, run, type, min("start") as "start", max("end") as "end" from r group by article_id, run, type""",
    "seek_to_part": f"""with {_REC}, a as (select *, least(article_id % 97, total) as goal from rec), f as (select *, row_number() over (partition by article_id order by part) as k from a where goal <= upto)
      select article_id, part, cast(goal - upto + seconds as bigint) as inside, cast(total as bigint) as total from f where k = 1""",
    "elapsed_before": f"with {_REC} select article_id, part, seconds, cast(upto - seconds as bigint) as before from rec",
    "sync_lookup": f"""with {_SYNC}, q as (select distinct article_id, article_id * 37 % 100 * 10000 as ratio from seg),
      m as (select q.article_id, ratio, ordinal, type, text, ratio < "end" as inside from sync join q on q.article_id = sync.article_id and "start" <= ratio),
      r as (select *, row_number() over (partition by article_id order by inside desc, case when inside then row(ordinal, type, text) end, case when not inside then row(ordinal, type, text) end desc) as k from m)
      select article_id, ratio, ordinal from r where k = 1""",
    "provider_fallback": f"with {_SEG} select distinct article_id, case when article_id % 2 = 0 then 'cache' when article_id % 3 = 0 then 'first' when article_id % 5 = 0 then 'second' end as provider from seg",
    "missing_work_plan": f"with {_WANTED} select article_id, requests, characters from wanted where not (article_id % 3 = 0 and article_id % 2 = 0) order by requests, article_id limit 25",
    "missing_work_totals": f"with {_WANTED} select count(*) as articles, cast(sum(characters) * 2 as bigint) as characters, cast(sum(requests) * 2 as bigint) as requests from wanted where article_id % 4 <> 0",
    "cost_plan": f"""with {_WANTED}, p as (select * from (values ('character'), ('token_25'), ('token_50'), ('rated')) v(provider)),
      e as (select provider, characters, case provider when 'character' then characters * 0.0001::double
        when 'token_25' then ceil(characters / 2.0::double) * 0.5::double / 1000000 + ceil(characters / 11.0::double * 25) * 10.0::double / 1000000
        when 'token_50' then ceil(characters / 2.0::double) * 0.6::double / 1000000 + ceil(characters / 11.0::double * 50) * 12.0::double / 1000000 end as usd from wanted, p),
      s as (select provider, case when count(usd) = count(*) then round(sum(usd), 4) end as usd, cast(sum(characters) as bigint) as characters from e group by provider)
      select *, case when characters > 200000 then 'stop' when characters >= 20000 then 'warn' else 'ok' end as gate,
        case when characters / 400000.0::double >= 0.95 then 0.95::double when characters / 400000.0::double >= 0.85 then 0.85::double when characters / 400000.0::double >= 0.7 then 0.7::double end as reached from s""",
    "content_fingerprint": f"with {_POSTS} select id, left(sha256(cast(id as varchar)), 16) as audio_key, sha256(body) as body_hash from posts",
    "lab_ranking": """with r as (select l_suppkey as candidate, l_linenumber as case_id, cast(l_quantity as int) % 6 as score from lineitem),
      s as (select candidate, sum(score) filter (where score between 1 and 5) as total, count(*) filter (where score between 1 and 5) as n, count(distinct case_id) filter (where score between 1 and 5) as cases from r group by candidate),
      w as (select o_orderkey % 100 + 1 as candidate, count(*) as wins from orders group by 1),
      m as (select candidate, cast(case when n > 0 then (total * 2000 + n) // (n * 2) end as bigint) as mean_milli, cases, coalesce(wins, 0) as wins from s left join w using (candidate))
      select *, row_number() over (order by coalesce(mean_milli, -1) desc, wins desc, candidate) as place from m""",
    "lab_criteria": "with r as (select l_suppkey as candidate, cast(l_quantity as int) % 6 as score, l_orderkey % 5 as k from lineitem) select candidate, "
    + ", ".join(f"round(avg(score) filter (where k = {i}), 3) as c{i}" for i in range(5))
    + " from r where score between 1 and 5 group by candidate",
    "lab_completion": "with r as (select count(*) filter (where cast(l_quantity as int) % 6 between 1 and 5) as d, count(*) as n from lineitem) select d as complete, n as total, cast(case when n = 0 then 0 else (d * 200 + n) // (n * 2) end as bigint) as percent from r",
    "lab_shuffle": "select c as case_id, s_suppkey as candidate, row_number() over (partition by c order by sha256('seed-1:' || c || ':' || s_suppkey)) as place from supplier, range(1, 7) t(c)",
    "review_leaks": "select distinct doc_id, item_id from documents d join benchmark b on b.text <> '' and contains(d.text, b.text)",
    "article_schema_failures": "with p as (select * from documents) select doc_id as id, 'no_title' as rule from p where coalesce(text, '') = '' union all select doc_id, 'short_text' from p where length(coalesce(text, '')) < 50",
    "latest_progress": "with r as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where event_type = 'view') select user_id, round(value, 4) as value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as ts from r where k = 1",
    "unexpired_progress": "with n as (select max(ts) as n from events), r as (select user_id, max(ts) as t from events where event_type = 'view' group by user_id) select user_id from r, n where t <= n and t >= n - interval 1 day",
    "reading_list_state": "select user_id, cast(floor(value) as bigint) % 10 as item from events where event_type = 'click' group by all having count(*) % 2 = 1",
    "read_depth_once": "select user_id, arg_min(event_id, row(ts, event_id)) as event_id from events where event_type = 'view' and value >= 75 group by user_id",
    "engaged_once": "with r as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) select user_id, event_id from r where k = 12",
    "consented_events": """with c as (select user_id, ts, event_id, null::boolean as granted, 1 as kind from events where event_type in ('view', 'click')
        union all select user_id, ts, 0, event_type = 'signup', 0 from events where event_type in ('signup', 'error')),
      l as (select *, last_value(granted ignore nulls) over (partition by user_id order by ts, kind, event_id rows between unbounded preceding and current row) as now from c)
      select event_id from l where kind = 1 and coalesce(now, false)""",
    "throttled_saves": """with recursive v as (select user_id, epoch_us(ts) as t, event_id from events where event_type = 'view'),
      k as (select user_id, t, event_id from (select *, row_number() over (partition by user_id order by t, event_id) as n from v) where n = 1
        union all select user_id, t, event_id from (select v.*, row_number() over (partition by v.user_id order by v.t, v.event_id) as n from k join v on v.user_id = k.user_id and v.t >= k.t + 3600000000) where n = 1)
      select user_id, event_id from k""",
    "numbered_customers": "select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) as rank from customer",
}
