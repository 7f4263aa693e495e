"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TRIMMED = rf"regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')"

ORACLES = {
    "op3_exact_dedup": rf"""
with d as (select doc_id, length(coalesce(text, '')) as cp, regexp_replace(coalesce(text, ''), '{WS}', '', 'g') as body from documents),
r as (
  select doc_id, body,
         first_value(doc_id) over (partition by body order by cp desc, doc_id) as keep_id,
         count(*) over (partition by body) as group_size
  from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(body) as text_sha256 from r""",
    "op4_line_dedup": rf"""
with l as (
  select doc_id, coalesce(source, '') as site, source is null as no_site, unnest(string_split(text, chr(10))) as line,
         unnest(range(len(string_split(text, chr(10))))) as pos
  from documents),
t as (select *, {TRIMMED} as core from l),
spread as (
  select core, min(row(doc_id, pos)) as first from t where core <> '' group by core having count(distinct row(no_site, site)) >= 10),
m as (
  select t.*, s.core is not null and row(t.doc_id, t.pos) <> s.first as gone from t left join spread s on t.core = s.core),
k as (
  select doc_id, coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as text,
         cast(count(*) as integer) as n_lines, cast(count(*) filter (gone) as integer) as n_removed
  from m group by doc_id)
select doc_id, text, n_lines, n_removed from k
union all select doc_id, text, 0, 0 from documents where text is null""",
    "op11_collocations": rf"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase
      from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (values (1), (2), (3)) as v(k) where len(w) >= k)),
f as (select lang, k, phrase, cast(count(*) as hugeint) as a from g group by lang, k, phrase having count(*) >= 10 or k = 1),
n as (select lang, cast(sum(a) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from f where k > 1 and a >= 10),
q as (select c.*, x.a as l, y.a as r, 1000000 * c.a * c.a // (x.a * y.a) as score
      from c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:cut], ' ')
             join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[cut + 1:], ' ')),
b as (select * from (select *, row_number() over (partition by lang, phrase order by score, cut) as best from q) where best = 1),
o as (select distinct x.lang, x.phrase from b x join (
        select lang, a, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) as phrase from b where k = 3) y
        on x.lang = y.lang and x.phrase = y.phrase where 100 * y.a >= 50 * x.a),
s as (select b.lang, row_number() over (partition by b.lang order by score desc, a desc, encode(b.phrase)) as rank, b.phrase, a, l, r, score
      from b anti join o on b.lang = o.lang and b.phrase = o.phrase)
select s.lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score
from s join n on n.lang = s.lang where rank <= 2000""",
    "op12_filter_audit": rf"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
m as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, min(doc_id) over (partition by t) as least from d),
b as (
  select part,
         cast(len(w) < 200 as int) + 2 * cast(100 * len(list_distinct(w)) < 50 * len(w) as int)
         + 4 * cast(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) as int)
         + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(least < m.doc_id, false) as int) as bits,
         coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic
  from m left join (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id) l on l.doc_id = m.doc_id),
c as (select part, bits, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from b group by part, bits),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(name, bit)),
o as (select x1.name || x2.name || x3.name || x4.name || x5.name as filter_order, unnest([
        {{'step': 1, 'before': 0, 'bit': x1.bit}}, {{'step': 2, 'before': x1.bit, 'bit': x2.bit}},
        {{'step': 3, 'before': x1.bit + x2.bit, 'bit': x3.bit}}, {{'step': 4, 'before': x1.bit + x2.bit + x3.bit, 'bit': x4.bit}},
        {{'step': 5, 'before': 31 - x5.bit, 'bit': x5.bit}}]) as s
      from x x1, x x2, x x3, x x4, x x5 where x1.bit + x2.bit + x3.bit + x4.bit + x5.bit = 31
        and (x1.bit | x2.bit | x3.bit | x4.bit | x5.bit) = 31),
r as (
  select part, filter_order, s.step as step, s.bit as bit,
         sum(n) filter (bits & (s.before | s.bit) = 0) as kept,
         sum(n) filter (bits & s.bit > 0 and bits & s.before = 0) as removed,
         sum(n) filter (bits & s.bit > 0 and bits & s.before > 0) as redundant,
         sum(n) filter (bits = s.bit) as unique_fails,
         sum(good) filter (bits & s.bit > 0 and bits & s.before = 0) as good_lost,
         sum(toxic) filter (bits & s.bit > 0 and bits & s.before = 0) as toxic_lost
  from c, o group by part, filter_order, s.step, s.bit)
select part, filter_order, cast(step as integer) as step, cast(coalesce(kept, 0) as bigint) as kept, cast(coalesce(removed, 0) as bigint) as removed,
       cast(coalesce(redundant, 0) as bigint) as redundant, cast(coalesce(unique_fails, 0) as bigint) as unique_fails,
       cast(coalesce(good_lost, 0) as bigint) as good_lost, cast(coalesce(toxic_lost, 0) as bigint) as toxic_lost,
       cast(coalesce(sum(removed) over (partition by part, bit), 0) as bigint) as shapley
from r""",
    "op13_decontamination": rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
i as (select distinct coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark),
p as (select distinct item, least(len(w), 10) as k, array_to_string(list_slice(w, s, s + least(len(w), 10) - 1), ' ') as pattern
      from (select *, unnest(range(1, len(w) - least(len(w), 10) + 2)) as s from i where len(w) > 0)),
x as (select doc_id, k, s, array_to_string(list_slice(w, s, s + k - 1), ' ') as pattern
      from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from p) where len(w) >= k)),
h as (select x.doc_id, x.s, x.k, p.item from x join p on p.k = x.k and p.pattern = x.pattern),
n as (select doc_id, count(distinct word) as n_hit from (select doc_id, unnest(range(s, s + k)) as word from h) group by doc_id),
j as (select doc_id, count(*) as n_items, string_agg(item, ',' order by encode(item)) as items from (select distinct doc_id, item from h) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n.n_hit, 0) as n_hit, coalesce(j.n_items, 0) as n_items,
       sha256(coalesce(j.items, '')) as items_sha256, n.n_hit is not null as contaminated
from d left join n on n.doc_id = d.doc_id left join j on j.doc_id = d.doc_id""",
}
