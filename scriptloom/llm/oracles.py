"""DuckDB SQL of the queries that SQL can express: written for small tables, from the contracts alone."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP1 = rf"""
with w as (select doc_id, {_TERMS} as ws from documents),
i as (select item_id, {_TERMS} as ws from benchmark where len({_TERMS}) > 0),
tok as (select doc_id, unnest(ws) as term, unnest(range(len(ws))) as pos from w),
ph as (select distinct ws, len(ws) as n, least(10, len(ws)) as sz from i),
it as (select ws, unnest(ws) as term, unnest(range(n)) as j from ph),
df as (select term, count(*) as c from tok group by term),
win as (select ws, sz, unnest(range(n - sz + 1)) as s from ph),
keys as (select distinct sz, array_to_string(ws[s + 1 : s + sz], ' ') as k, ws from win),
dw as (select doc_id, sz, unnest(range(greatest(len(ws) - sz + 1, 0))) as p, ws from w, (select distinct sz from win)),
dk as (select doc_id, sz, p, array_to_string(ws[p + 1 : p + sz], ' ') as k from dw),
occ as (select doc_id, p, dk.sz, keys.ws from dk join keys using (sz, k)),
hit as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + sz)) as q from occ) group by doc_id),
names as (select doc_id, list_sort(list(distinct item_id::varchar)) as ids from (select distinct doc_id, ws from occ) join i using (ws) group by doc_id),
rare as (select ws, s, j, sz, row_number() over (partition by ws, s order by coalesce(c, 0), j) as r from win join it using (ws) left join df using (term) where j >= s and j < s + sz),
pick as (select ws, s, list(j) as js, least(3, any_value(sz)) as k from rare where r <= least(3, sz) group by ws, s),
h as (select distinct doc_id, ws, j, unnest([floor((pos - j) / 6.0)::int, floor((pos - j) / 6.0)::int - 1]) as span from (select distinct ws, unnest(js) as j from pick) join it using (ws, j) join tok using (term)),
g as (select doc_id, ws, span, list(j) as js from h group by all),
near as (select distinct doc_id, ws from g join pick using (ws) where len(list_intersect(g.js, pick.js)) = pick.k),
nn as (select doc_id, count(distinct item_id) as n_near from near join i using (ws) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(ids), 0)::bigint as n_items, sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from w left join hit using (doc_id) left join names using (doc_id) left join nn using (doc_id)
"""


def _rules() -> str:
    tests = []
    for r in RULES:
        ratio = f"(case when {r.of} = 0 then 0.0 else {r.count}::double / {r.of} end)"
        tests += [f"{ratio} >= {r.low}"] if r.low > float("-inf") else []
        tests += [f"{ratio} <= {r.high}"] if r.high < float("inf") else []
    return " and ".join(tests)


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]))

OP5 = rf"""
with m as (select doc_id, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) as ls from documents),
wk as (select doc_id, p, array_to_string(ws[p + 1 : p + 8], ' ') as k from (select doc_id, ws, unnest(range(greatest(len(ws) - 7, 0))) as p from m)),
rp as (select doc_id, p from (select *, count(*) over (partition by doc_id, k) as c from wk) where c > 1),
rep as (select doc_id, count(distinct q) as n_repeat_words from (select doc_id, unnest(range(p, p + 8)) as q from rp) group by doc_id),
c as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, len(ls) as n_lines, len(list_filter(ws, lambda x: x in ({_STOP}))) as n_stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) as n_lettered,
  len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}{{2,}}[^\p{{Ll}}]*$'))) as n_shouted, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stuttered,
  len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t-\r]*[-*•]'))) as n_bullet_lines, len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t-\r]*$'))) as n_ellipsis_lines
  from m left join rep using (doc_id)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and {_rules()} as kept from f
"""

OP8 = rf"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \t-\r]+'), lambda x: x <> '') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[p + 1 : p + 3], ' ') as g from (select doc_id, ws, unnest(range(greatest(len(ws) - 2, least(len(ws), 1)))) as p from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select x, y from pairs join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 90 * (a.n + b.n - c)),
reach as (select doc_id, doc_id as other from w union select r.doc_id, l.y from reach r join links l on r.other = l.x)
select doc_id, coalesce(any_value(n), 0)::bigint as n_shingles, min(other) as component_id from reach left join n using (doc_id) group by doc_id
"""

OP12 = r"""
with recursive tab(n, v, k) as (select n, n, 0 from range(256) r(n) union all select n, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from tab where k < 8),
src as (select dense_rank() over (order by conv_id nulls first) as g, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations),
crc(s, i, c) as (select distinct s, 0, 4294967295 from src union all select s, i + 1, xor(c >> 8, v) from crc join tab on k = 8 and n = xor(c & 255, ascii(substring(s, i + 1, 1))) where i < length(s)),
fault as (select s, xor(c, 4294967295) % 20 as f from crc where i = length(s)),
dam as (select g, turn, case f when 4 then 'user' else role end as role, case f when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case f when 3 then 2 else 1 end)) from src join fault using (s) where f <> 0),
ord as (select g, turn, role, text, left(role, 1) as i, row_number() over (partition by g order by turn nulls first, role, text) as p, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from dam),
rows as (select *, t = '' as blank, t <> '' and row_number() over (partition by g, role, text order by p) > 1 as dup, lag(i) over (partition by g order by p) || i as pair from ord),
r as (select *, not blank and not dup and not regexp_matches(t, '[.!?]$') as cut from rows),
ins(q, n, q2) as (values (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
nxt(q2, i, q3) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
act as (select q, n, q2, n2.i, q3, a.x from ins join nxt n2 using (q2), (values ('K'), ('R')) a(x) where a.x = 'K' or n2.i <> 's' union all select q, n, q2, null, q2, 'D' from ins),
dp(g, p, q, cost, audit) as (select distinct g, 0::bigint, 0, 0::bigint, '' from r union all
 select g, p, q3, best.c, best.a from (select dp.g, r.p, act.q3, min({'c': dp.cost + 2 * act.n + case act.x when 'D' then 3 when 'R' then 2 + cut::int else cut::int end, 'a': audit || repeat('I', act.n) || act.x}) as best
  from dp join r on r.g = dp.g and r.p = dp.p + 1 join act on act.q = dp.q and (act.x = 'D' or (not blank and not dup and (act.x = 'R' or act.i = r.i))) group by all)),
fin as (select g, min({'c': cost + 2 * n, 'a': audit || repeat('I', n)}) as best from dp join (select g, max(p) as p from r group by g) using (g, p) join ins using (q) where (q2 = 3 or (q = 0 and n = 0)) group by g),
let as (select g, unnest(range(1, length(best.a) + 1)) as j, substring(best.a, j, 1) as x from fin),
cnt as (select *, count(*) filter (x <> 'I') over w as p, count(*) filter (x <> 'D') over w as k from let window w as (partition by g order by j)),
put as (select cnt.*, r.role, r.text, max((k = 1 and x = 'K' and r.i = 's')::int) over (partition by cnt.g) as lead from cnt left join r on r.g = cnt.g and r.p = cnt.p and x in ('K', 'R')),
txt as (select g, string_agg(case when x = 'K' then role when (k - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by j) as t from put where x <> 'D' group by g),
cnts as (select g, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (dup) as duplicate, count(*) filter (cut) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from r group by g)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
 coalesce(best.c, 0)::bigint as cost, coalesce(best.a, '') as audit, sha256(coalesce(t, '')) as repaired_sha256
from (select distinct g, conv_id from src) left join cnts using (g) left join fin using (g) left join txt using (g)
"""

OP13 = r"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, case when len(words) < 100 then 1 else 0 end + case when 100 * len(list_distinct(words)) < 80 * len(words) then 2 else 0 end
 + case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
 + case when coalesce(w.doc_id > min(w.doc_id) over (partition by t), false) then 16 else 0 end as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from w left join l on w.doc_id = l.doc_id),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(x, b)),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order, [a.b, b.b, c.b, d.b, e.b] as bits from f a, f b, f c, f d, f e where a.b | b.b | c.b | d.b | e.b = 31),
s as (select filter_order, k::int as step, bits[k] as bit, list_sum(bits[:k]) - bits[k] as before from o, range(1, 6) r(k)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
r as (select part, filter_order, step, bit, coalesce(sum(n) filter (mask & before = 0 and mask & bit = 0), 0)::bigint as kept, coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as removed,
 coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0)::bigint as redundant, coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
 coalesce(sum(good) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as good_lost, coalesce(sum(toxic) filter (mask & before = 0 and mask & bit <> 0), 0)::bigint as toxic_lost from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) over (partition by part, bit)::bigint as shapley from r
"""
