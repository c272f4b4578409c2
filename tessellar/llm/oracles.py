"""DuckDB SQL for the queries that SQL can express."""

from .quality_rules import Rules

_LEAST, _MOST = (" ".join(f"when '{k}' then {v}" for k, v in by.items()) for by in (Rules().least, Rules().most_tail))

OP10 = rf"""
with t as (select doc_id, coalesce(text, '') as s, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
dup as (select doc_id, i from (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t)) qualify count(*) over (partition by doc_id, g) > 1),
rep as (select doc_id, count(distinct i + k) as n_repeat_words from dup, (values (0), (1), (2)) as v(k) group by doc_id),
c as (select doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(s, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
  length(regexp_replace(s, '\P{{Lu}}+', '', 'g')) as n_upper, length(regexp_replace(s, '[^!]+', '', 'g')) as n_shout, coalesce(n_repeat_words, 0) as n_repeat_words from t left join rep using (doc_id)),
m as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c),
x as (select doc_id, lang, source, base_failed, unnest(['r_symbols', 'r_dup_lines', 'r_repeat', 'r_length', 'r_upper', 'r_shout']) as k,
  unnest([1000 * n_symbols // greatest(n_words, 1), 1000 * n_dup_lines // greatest(n_lines, 1), 1000 * n_repeat_words // greatest(n_words, 1), 100 * word_chars // greatest(n_words, 1), 1000 * n_upper // greatest(word_chars, 1), 1000 * n_shout // greatest(n_words, 1)]) as v from m),
y as (select lang, source, k, ((v >> w) + 1) * (1 << w) - 1 as v from (select *, greatest(length(bin(v)) - 6, 0) as w from x where not base_failed)),
lev as (select 0 as level, lang, source, k, v from y union all select 1, lang, null, k, v from y union all select 2, null, null, k, v from y),
q as (select level, lang, source, k, n, min(case when 4 * rn >= n then v end) as q25, min(case when 4 * rn >= 3 * n then v end) as q75, min(case when 200 * rn >= 199 * n then v end) as q995
  from (select *, row_number() over (partition by level, lang, source, k order by v) as rn, count(*) over (partition by level, lang, source, k) as n from lev) group by all),
lim as (select *, greatest(q75 + {Rules().spread} * (q75 - q25), case k {_LEAST} end, least({Rules().tail} * q995, case k {_MOST} end)) as most from q where level = 2 or n >= {Rules().least_rows}),
bad as (select x.doc_id, bool_or(x.v > least(coalesce(a.most, b.most, o.most), {Rules().most} * o.most)) as above from x left join lim a on a.level = 0 and a.k = x.k and a.lang is not distinct from x.lang and a.source is not distinct from x.source
  left join lim b on b.level = 1 and b.k = x.k and b.lang is not distinct from x.lang left join lim o on o.level = 2 and o.k = x.k group by x.doc_id)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, not base_failed and not coalesce(above, false) as kept from m left join bad using (doc_id)
"""

OP3 = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, case when len(w) >= 3 then w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] else array_to_string(w, chr(1)) end as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from documents union select r.doc_id, e.b from r join e on e.a = r.c)
select d.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, min(r.c) as component_id from documents d join r using (doc_id) left join n using (doc_id) group by d.doc_id
"""

OP12 = r"""
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_dot_product(a.v, b.v) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where not same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""

OP11 = r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from t)),
r as (select doc_id, i from g qualify row_number() over (partition by g order by doc_id, i) > 1),
c as (select distinct doc_id, i + k as i from r, (select unnest(range(20)) as k)),
x as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from t),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by i) as s from x anti join c using (doc_id, i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256 from t left join kept using (doc_id)
"""

OP13 = r"""
with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from t),
g as (select lang, s, array_to_string(w[i:i + s - 1], ' ') as phrase from (select lang, w, s, unnest(range(1, len(w) - s + 2)) as i from w, (values (1), (2), (3)) as v(s))),
f as (select lang, s, phrase, count(*) as a from g group by all),
n as (select lang, sum(a) as n from f where s = 1 group by lang),
c as (select lang, s, phrase, a, string_split(phrase, ' ') as w from f where s > 1 and a >= 10),
k as (select *, array_to_string(w[1:k], ' ') as first, array_to_string(w[k + 1:], ' ') as rest from (select *, unnest(range(1, s)) as k from c)),
x as (select k.lang, k.phrase, k.s, k.a, k.k, l.a as l, r.a as r, cast(cast(1000000 as hugeint) * k.a * k.a // (cast(l.a as hugeint) * r.a) as bigint) as score
  from k join f l on l.lang = k.lang and l.phrase = k.first and l.s = k.k join f r on r.lang = k.lang and r.phrase = k.rest and r.s = k.s - k.k),
m as (select * from x qualify row_number() over (partition by lang, phrase order by score, k) = 1),
h as (select lang, phrase, max(a) as longer from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase from c where s = 3) group by all),
d as (select m.*, row_number() over (partition by lang order by score desc, m.a desc, phrase) as rank from m left join h using (lang, phrase) where longer is null or 100 * longer < 50 * m.a)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from d join n using (lang) where rank <= 2000
"""
