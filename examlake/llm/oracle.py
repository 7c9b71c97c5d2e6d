"""The document queries that SQL can express, in DuckDB's dialect."""

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
with item as (select cast(item_id as varchar) as item, {TOKENS} as w from benchmark where item_id is not null),
spread as (select item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as i from item where len(w) > 0),
gram as (select distinct item, array_to_string(w[i:i + 12], ' ') as g, least(len(w), 13) as n from spread),
doc as (select doc_id, {TOKENS} as w from documents),
size as (select distinct n from gram),
place as (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from doc, size where len(w) >= n),
hit as (select p.doc_id, p.i, p.n, g.item from (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g from place) p join gram g on g.g = p.g and g.n = p.n),
word as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(i, i + n)) as pos from hit) group by 1),
found as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as ids from hit group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from doc d left join word using (doc_id) left join found using (doc_id)
"""

OP2 = f"""
with doc as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size,
    cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), 'null')), 1, 15) as bigint) as place
  from documents),
source as (select source, cast(sum(size) as bigint) as source_size from doc group by 1),
weighed as (select *, [3.0, 1.0, 2.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from source),
capped as (select *, 2.0::double * source_size as cap, row_number() over (order by 2.0::double * source_size / weight, source nulls last) as r from weighed),
run as (
  select *, coalesce(sum(cap) over (order by r rows between unbounded preceding and 1 preceding), 0) as taken,
    sum(weight) over (order by r rows between current row and unbounded following) as open
  from capped),
level as (select min_by((1.5::double * (select sum(source_size) from source) - taken) / open, r) as rate from run
  where (1.5::double * (select sum(source_size) from source) - taken) / open * weight <= cap),
aim as (select source, source_size, least(cap, weight * (select rate from level)) as target from capped),
whole as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as times from aim),
placed as (
  select d.doc_id, d.size, w.source_size, w.target, w.times, w.target - w.times * w.source_size as rest,
    sum(d.size) over (partition by d.source order by d.place, d.doc_id) - d.size as before
  from doc d join whole w on d.source is not distinct from w.source)
select doc_id, size, source_size, target,
  cast(size * (times + case when rest > 0 and before + size / 2.0 <= rest then 1 else 0 end) as bigint) as taken
from placed
"""

OP4 = r"""
with line as (
  select doc_id, l, i,
    translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(s) as l, unnest(range(len(s))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))),
spread as (select k, max(doc_id) as owner from line where length(k) >= 20 group by 1 having count(distinct doc_id) >= 3),
judged as (select l.*, s.owner is not null and s.owner <> l.doc_id as gone from line l left join spread s using (k))
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(l, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""

OP7 = f"""
with doc as (select doc_id, {WORDS} as w from documents),
place as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from doc where len(w) >= 13)),
first as (select g, min(doc_id) as least from place group by 1),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as at from place join first using (g) where least < doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as at from doc),
kept as (select w.doc_id, string_agg(x, ' ' order by w.at) as text from word w left join gone g on g.doc_id = w.doc_id and g.at = w.at where g.at is null group by 1),
count_ as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from doc d left join kept k using (doc_id) left join count_ using (doc_id)
"""

OP11 = r"""
with doc as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as u,
    sha256('7:' || coalesce(cast(doc_id as varchar), 'null')) as h
  from documents),
drawn as (
  select doc_id, t, u, cast(len(u) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(u) + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (len(u) + 1) as y,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or cast('0x' || substr(h, 17, 8) as bigint) % 100 >= 100 then 'plain'
      when cast('0x' || substr(h, 25, 8) as bigint) % 100 < 50 then 'spm' else 'psm' end as form
  from doc),
cut as (
  select *, coalesce(array_to_string(u[1:least(x, y)], ''), '') as p, coalesce(array_to_string(u[least(x, y) + 1:greatest(x, y)], ''), '') as m,
    coalesce(array_to_string(u[greatest(x, y) + 1:], ''), '') as s
  from drawn)
select doc_id, n, form, case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'spm' then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from cut
"""

OP13 = rf"""
with doc as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWERED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
word as (select r, lang, source, unnest(w) as term from doc),
own as (select lang, source, term, count(*) as n, count(distinct r) as docs from word group by all),
kept as (select lang, term, cast(sum(n) as hugeint) as n from own group by all having sum(docs) >= 30),
size as (select lang, count(*) as v, sum(n) as total from kept group by 1),
grp as (select distinct lang, source from doc),
full_ as (
  select g.lang, g.source, k.term, cast(coalesce(o.n, 0) as hugeint) as n, k.n as lang_n from grp g join kept k using (lang) left join own o using (lang, source, term)),
share as (
  select f.lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by f.lang, source) + 5 * v) as p,
    1 + (1000000000::hugeint * (lang_n + 5)) // (total + 5 * v) as q
  from full_ f join size z on f.lang = z.lang),
gap as (
  select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from share a join share b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(value, 0) as bigint) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source left join gap g on g.lang = a.lang and g.source = a.source and g.item = b.source),
term as (select lang, source, 'term' as part, term as item, cast(p - q as bigint) as value from share where n > 0 and p > q),
ranked as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1,
        "op2_mix_sources": OP2,
        "op4_line_dedup": OP4,
        "op7_substring_dedup": OP7,
        "op11_fill_in_middle": OP11,
        "op13_source_divergence": OP13,
    }
