"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP5 = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
phrases as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as k
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
sizes as (select distinct n from phrases),
starts as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
grams as (select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as k from starts, sizes where p + n - 1 <= len(w)),
found as (select doc_id, p, n, item_id from grams join phrases using (n, k)),
hits as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from found) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as s from (select distinct doc_id, cast(item_id as varchar) as i from found) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)
"""

_OP7 = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as n from documents)
select doc_id, min(doc_id) over (partition by n) as keep_id, count(*) over (partition by n) as group_size,
  doc_id = min(doc_id) over (partition by n) as kept, sha256(n) as text_sha256
from t
"""

_OP2 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, p, array_to_string(w[p : p + 49], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from d where len(w) >= 50)),
f as (select k, min(doc_id) as m from g group by k),
gone as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 50)) as q from g join f using (k) where m < doc_id)),
words as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as q from d where len(w) > 0),
kept as (select doc_id, string_agg(x, ' ' order by q) as s, count(*) as n from words anti join gone using (doc_id, q) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) as bigint) - coalesce(n, 0) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join kept using (doc_id)
"""

_OP3 = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[p : p + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as p from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id <> b.doc_id group by all),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select doc_id as a, doc_id as r from documents union select reach.a, links.b from reach join links on links.a = reach.r)
select documents.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents left join n using (doc_id)
join (select a, min(r) as component_id from reach group by a) m on m.a = documents.doc_id
"""

_OP11 = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.q, b.q) as bigint) as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank, id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

_OP12 = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, coalesce(min(doc_id) over (partition by t) < doc_id, false) as copy from t),
m as (select doc_id, part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'), copy][i]) as fails from w),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m left join l using (doc_id) group by part, fails),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select filter_order, step, filter_order[step] as own, string_split(filter_order[1 : step - 1], '') as before from o, range(1, 6) r(step)),
x as (select c.*, s.*, list_contains(fails, own) as hit, list_has_any(fails, before) as gone from c, s),
y as (select part, filter_order, cast(step as integer) as step, own, sum(case when not hit and not gone then n else 0 end) as kept, sum(case when hit and not gone then n else 0 end) as removed,
  sum(case when hit and gone then n else 0 end) as redundant, sum(case when fails = [own] then n else 0 end) as unique_fails,
  sum(case when hit and not gone then good else 0 end) as good_lost, sum(case when hit and not gone then toxic else 0 end) as toxic_lost from x group by part, filter_order, step, own)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from y
"""

ORACLE: dict[str, str] = {"op2_substring_dedup": _OP2, "op3_ngram_join": _OP3, "op5_decontamination": _OP5, "op7_exact_dedup": _OP7, "op11_hard_negatives": _OP11, "op12_filter_audit": _OP12}
