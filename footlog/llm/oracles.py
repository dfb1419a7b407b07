"""The corpus operators that SQL can express, as DuckDB SQL."""

from __future__ import annotations

#: Integer inner products of every query vector with every other one, straight from the definition.
OP5 = """
with v as (
  select vec_id, row_number() over () n, list_transform(embedding, lambda x: floor(256 * x::double)) e
  from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (
  select q.vec_id query_id, q.n, c.vec_id vec_id, list_inner_product(q.e, c.e)::bigint score
  from v q join v c on c.n <> q.n and len(c.e) = len(q.e) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id, n order by score desc, vec_id)::int rank from p)
select query_id, rank, vec_id, score from r where rank <= 5
"""


#: All windows of lines with at least 50 words, forward and backward, against the earliest one of equal content.
OP4 = r"""
with t as (select doc_id, string_split(text, chr(10)) a from documents where text is not null),
l as (select doc_id, unnest(a) v, generate_subscripts(a, 1) - 1 line from t),
n as (select *, len(regexp_extract_all(v, '[^\x20\x09-\x0D]+')) w from l),
c as (select *, sum(w) over (partition by doc_id order by line) stop from n where w > 0),
d as (select *, stop - w as start from c),
b as (
  select doc_id, line as first, max(line) over f as last, sum(w) over f held, list(v) over f content from d
    window f as (partition by doc_id order by start range between current row and 49 following)
  union
  select doc_id, min(line) over g, line, sum(w) over g, list_reverse(list(v) over g) from d
    window g as (partition by doc_id order by stop desc range between current row and 49 following)),
r as (select distinct doc_id, first, last, content from b where held >= 50),
e as (select content, min({'d': doc_id, 'f': first, 'l': last}) x from r group by content having count(*) > 1),
h as (
  select doc_id, case when doc_id = x.d then greatest(first, x.l + 1) else first end as first, last, x.d source
  from r join e using (content) where {'d': doc_id, 'f': first, 'l': last} > x),
k as (select * from h where first <= last),
g as (select distinct l.doc_id, l.line from l join k on k.doc_id = l.doc_id and l.line between k.first and k.last),
s as (select doc_id, count(distinct source) sources, min(source) first_source from k group by doc_id),
o as (
  select l.doc_id, count(g.line) removed, count(*) - count(g.line) kept,
    coalesce(string_agg(case when g.line is null then l.v end, chr(10) order by l.line), '') new_text
  from l left join g on g.doc_id = l.doc_id and g.line = l.line group by l.doc_id)
select o.doc_id, greatest(kept, 1)::int lines_left, removed::int lines_removed, coalesce(sources, 0)::int sources, first_source, sha256(new_text) text_sha256
from o left join s using (doc_id)
"""

#: The lookup table filled turn by turn, then every document's slot in it.
OP7 = """
with recursive shard as (
  select i::int i, 'shard-' || lpad(i::varchar, 2, '0') as name from range(64) x(i)),
pref as (
  select list(('0x' || substr(md5(name || '/offset'), 1, 15))::bigint % 6469 order by i) offs,
         list(('0x' || substr(md5(name || '/skip'), 1, 15))::bigint % 6468 + 1 order by i) skips from shard),
fill(step, slot, turns, taken) as (
  select 0, -1::bigint, list_transform(range(64), lambda z: 0::bigint), list_transform(range(6469), lambda z: false)
  union all
  select step + 1, spot, list_transform(turns, lambda t, q: case when q = step % 64 + 1 then j else t end),
         list_transform(taken, lambda t, q: t or q = spot + 1)
  from (
    select step, turns, taken, j, (offs[step % 64 + 1] + j * skips[step % 64 + 1]) % 6469 as spot
    from (
      select step, turns, taken, offs, skips,
        list_filter(range(turns[step % 64 + 1], turns[step % 64 + 1] + 6469),
                    lambda z: not taken[(offs[step % 64 + 1] + z * skips[step % 64 + 1]) % 6469 + 1])[1] as j
      from fill, pref where step < 6469))),
lookup as (select slot, 'shard-' || lpad(((step - 1) % 64)::varchar, 2, '0') as shard from fill where step > 0)
select doc_id, d.slot::int as slot, shard
from (select doc_id, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint % 6469 as slot from documents) d join lookup using (slot)
"""


#: Every window of one to four words of every piece, counted as it stands.
OP12 = r"""
with t as (
  select coalesce(lang, 'und') lang, doc_id, row_number() over () id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') v from documents),
p as (select lang, unnest(regexp_split_to_array(v, '[.,;:!?\x0A-\x0D]')) v from t),
w as (select lang, regexp_extract_all(v, '[^\x20\x09]+') a from p),
g as (select lang, len(x) words, array_to_string(x, ' ') phrase from (
  select lang, unnest(flatten(list_transform(range(1, 5), lambda m: list_transform(range(1, len(a) - m + 2), lambda i: a[i:i + m - 1])))) x from w)),
f as (select lang, words, phrase, count(*)::hugeint a from g group by all),
n as (select lang, sum(a)::hugeint n from f where words = 1 group by lang),
c as (select lang, words, phrase, a, string_split(phrase, ' ') x from f where words > 1 and a >= 30),
k as (select *, unnest(range(1, words)) k from c),
s as (
  select k.lang, k.phrase, k.a, k.k, l.a l, r.a r, (2000000 * k.a) // (l.a + r.a) score from k
  join f l on l.lang = k.lang and l.phrase = array_to_string(k.x[1:k.k], ' ') and l.words = k.k
  join f r on r.lang = k.lang and r.phrase = array_to_string(k.x[k.k + 1:], ' ') and r.words = k.words - k.k),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (
  select lang, array_to_string(x[j:j + m - 1], ' ') phrase, max(a) outer_a
  from (select *, unnest(range(1, words - m + 2)) j from (select *, unnest(range(2, words)) m from c)) group by all),
o as (select b.* from b left join i using (lang, phrase) where outer_a is null or 100 * outer_a < 80 * b.a),
z as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from o)
select z.lang, rank, phrase, a::bigint a, l::bigint l, r::bigint r, n.n::bigint n, score::bigint score from z join n using (lang) where rank <= 2000
"""

#: The cuts as counts of matches, taken from the list of all matches.
OP13 = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
u as (
  select *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') a,
    ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2, ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
c as (select *, len(a) n, least(h1 % (len(a) + 1), h2 % (len(a) + 1)) lo, greatest(h1 % (len(a) + 1), h2 % (len(a) + 1)) hi from u),
p as (
  select *, array_to_string(a[1:lo], '') pre, array_to_string(a[lo + 1:hi], '') mid, array_to_string(a[hi + 1:], '') suf,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end form from c)
select doc_id, n::bigint n, form, case when form <> 'plain' then length(pre) end prefix_chars, case when form <> 'plain' then length(mid) end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
  sha256(t) restored_sha256
from p
"""


def llm_oracles() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op5_threshold_top_k": OP5, "op7_sharding": OP7, "op12_collocations": OP12, "op13_fill_in_middle": OP13}
