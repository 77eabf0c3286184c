"""Queries on style sheets and colours, each with its DuckDB SQL. The sheet of a page is what stands in its style element
and rules whose values follow from its number, so that the SQL has them without parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import audit, styles
from ..operators.styles import Expected
from ..sources import tables as T
from ..sources.styles import parsed
from .registry import registered

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
query = registered(QUERIES, ORACLE)

WIDTHS = [320, 480, 768, 1024]
_RULES = r"""
/* sheet %1$d: .grid{gap:99px} ; */ @charset "utf-8";
.grid , .cards > a:not(.x, .y){ grid-template-columns : repeat(3,1fr) ; gap:%2$dpx}
@media (min-width:600px) and (max-width:%3$dpx){.grid{gap:%4$dpx !important}.nav{height:%5$dpx}}
@media screen{@supports (display:grid){@media (width <= %6$dpx){.grid{grid-template-columns:minmax(0,1fr)}.nav{min-height:44px;height:%7$dpx;}}}}
.nav::before{content:"};%1$d"}
p,.nav{margin:0 0 %8$dpx;flex:1 1  %3$dpx}
@font-face{src:url(data:font/woff;base64,AA==)}
"""


def _sheets(spark, d):
    p, k = T.table(spark, d, "pages"), F.col("page_id")
    numbers_ = [k, k % 9, k % 500 + 700, k % 5, k % 13 + 38, k % 400 + 300, k % 7 + 40, k % 4]
    rules = F.format_string(_RULES, *(n.cast("long") for n in numbers_))
    return p.select("page_id", F.concat(F.regexp_extract("html", r"(?s)<style>(.*?)</style>", 1), rules).alias("css"))


_DECLARED = r"""with k as (select page_id as k, regexp_extract(html, '<style>p\{margin:([^}]*)\}</style>', 1) as own from pages),
  r as (select k, 'p' as selector, 'margin' as prop, own as value, null::double as lo, null::double as hi, 0 as ord from k where own <> ''
    union all select k, s, 'grid-template-columns', 'repeat(3,1fr)', null, null, 1 from k, (values ('.grid'), ('.cards > a:not(.x, .y)')) v(s)
    union all select k, s, 'gap', k % 9 || 'px', null, null, 2 from k, (values ('.grid'), ('.cards > a:not(.x, .y)')) v(s)
    union all select k, '.grid', 'gap', k % 5 || 'px', 600, k % 500 + 700, 3 from k
    union all select k, '.nav', 'height', k % 13 + 38 || 'px', 600, k % 500 + 700, 4 from k
    union all select k, '.grid', 'grid-template-columns', 'minmax(0,1fr)', null, k % 400 + 300, 5 from k
    union all select k, '.nav', 'min-height', '44px', null, k % 400 + 300, 6 from k
    union all select k, '.nav', 'height', k % 7 + 40 || 'px', null, k % 400 + 300, 7 from k
    union all select k, '.nav::before', 'content', '"};' || k || '"', null, null, 8 from k
    union all select k, s, 'margin', '0 0 ' || k % 4 || 'px', null, null, 9 from k, (values ('p'), ('.nav')) v(s)
    union all select k, s, 'flex', '1 1  ' || k % 500 + 700 || 'px', null, null, 10 from k, (values ('p'), ('.nav')) v(s)),
  c as (select k as page_id, selector, prop, width, arg_max(value, ord) as value from r, (values (320.0::double), (480), (768), (1024)) w(width)
    where coalesce(lo <= width, true) and coalesce(width <= hi, true) group by all)"""


@query(_DECLARED + " select * from c")
def cascade_resolve(spark, d):
    """What holds at each width, for every selector and property of every page's sheet."""
    return styles.resolved(parsed(_sheets(spark, d), "page_id"), WIDTHS, by=["page_id"], order=["ord"])


EXPECTED = [
    Expected(".grid", "grid-template-columns", 320, "is", "minmax(0,1fr)"),
    Expected(".grid", "grid-template-columns", 1024, "holds", "repeat(3"),
    Expected(".nav", "height", 320, "at_least", "44"),
    Expected(".nav", "height", 768, "at_least", "44"),
    Expected(".nav", "flex", 480, "basis", "777px"),
    Expected(".cards > a:not(.x, .y)", "gap", 480, "is", "3px"),
    Expected(".absent", "color", 480, "is", "red"),
]


@query(_DECLARED + r""", e as (select * from (values ('.grid', 'grid-template-columns', 320.0::double, 'is', 'minmax(0,1fr)'), ('.grid', 'grid-template-columns', 1024, 'holds', 'repeat(3'), ('.nav', 'height', 320, 'at_least', '44'), ('.nav', 'height', 768, 'at_least', '44'), ('.nav', 'flex', 480, 'basis', '777px'), ('.cards > a:not(.x, .y)', 'gap', 480, 'is', '3px'), ('.absent', 'color', 480, 'is', 'red')) v(selector, prop, width, kind, want))
  select p.page_id, e.selector, e.prop, e.width, e.kind, c.value from pages p cross join e left join c on c.page_id = p.page_id and c.selector = e.selector and c.prop = e.prop and c.width = e.width
  where not coalesce(case kind when 'is' then value = want when 'holds' then contains(value, want) when 'at_least' then replace(value, 'px', '')::double >= want::double else value = '1 1  ' || want end, false)""")
def style_failures(spark, d):
    """Expectations on every page's sheet that do not hold."""
    sheets = _sheets(spark, d)
    found = styles.failures(parsed(sheets, "page_id"), EXPECTED, sheets, by=["page_id"], order=["ord"])
    return found.select("page_id", "selector", "prop", "width", "kind", "value")


@query("""with c as (select p_partkey, '#' || lpad(lower(to_hex(p_partkey * 7919 % 16777216)), 6, '0') as front, '#' || lpad(lower(to_hex((p_partkey * 104729 + 8388607) % 16777216)), 6, '0') as back from part),
  x as (select p_partkey, [cast(('0x' || substring(k, i, 2)) as int) / 255.0::double for i in [2, 4, 6]] as rgb from (select p_partkey, front as k from c union all select p_partkey, back from c)),
  y as (select p_partkey, [case when v <= 0.04045 then v / 12.92 else pow((v + 0.055) / 1.055, 2.4) end for v in rgb] as l from x),
  z as (select p_partkey, max(0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3]) as hi, min(0.2126 * l[1] + 0.7152 * l[2] + 0.0722 * l[3]) as lo from y group by p_partkey)
  select p_partkey, round((hi + 0.05) / (lo + 0.05), 2) as ratio from z where (hi + 0.05) / (lo + 0.05) < 4.5""")
def contrast_audit(spark, d):
    """Pairs of colours, made from the numbers of parts, that are too much alike to be read."""
    colour = lambda n: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(n % 16777216)), 6, "0"))
    k = F.col("p_partkey")
    pairs = T.table(spark, d, "part").select("p_partkey", colour(k * 7919).alias("front"), colour(k * 104729 + 8388607).alias("back"))
    return audit.low_contrast(pairs).select("p_partkey", F.round("ratio", 2).alias("ratio"))


@query(r"""with m as (select s_suppkey, s_suppkey * 104729 % 16777216 as f, s_suppkey * 7919 % 16777216 as b from supplier),
  c as (select s_suppkey, [floor((((f // p) % 256) * 0.12 + ((b // p) % 256) * 0.88) + 0.5)::int for p in [65536, 256, 1]] as v from m)
  select s_suppkey, '#' || lpad(lower(to_hex(v[1])), 2, '0') || lpad(lower(to_hex(v[2])), 2, '0') || lpad(lower(to_hex(v[3])), 2, '0') as mixed from c""")
def mixed_colours(spark, d):
    """A colour with an eighth of another one, as the tint of a surface."""
    colour = lambda n: F.concat(F.lit("#"), F.lpad(F.lower(F.hex(n % 16777216)), 6, "0"))
    k = F.col("s_suppkey")
    return T.table(spark, d, "supplier").select("s_suppkey", numbers.mixed_colour(colour(k * 104729), colour(k * 7919)).alias("mixed"))
