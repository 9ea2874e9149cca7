"""DuckDB SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

FILL_IN_MIDDLE = r"""
with d as (select doc_id, coalesce(text, '') t, sha256('1:' || coalesce(cast(doc_id as varchar), '')) h from documents),
h as (
  select *, cast(length(t) as bigint) n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
    ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4
  from d
),
c as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end form
  from h
),
p as (select *, substr(t, 1, a) prefix, substr(t, a + 1, b - a) middle, substr(t, b + 1) suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end prefix_chars, case when form <> 'plain' then b - a end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) output_sha256, sha256(t) restored_sha256
from p
"""

LEXICAL = r"""
with word as (
  select doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from documents
),
posting as (select doc_id, term, count(*) tf from word group by all),
doc as (select doc_id, cast(sum(tf) as bigint) len from posting group by doc_id),
whole as (select count(*) n_docs, cast(sum(len) as bigint) n_terms from doc),
item as (
  select distinct item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term
  from benchmark
),
weight as (
  select term, cast(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) as bigint) w
  from (select term, count(*) df from posting group by term), whole
),
scored as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len * n_docs) // n_terms)))) as bigint) score
  from item join weight using (term) join posting using (term) join doc using (doc_id), whole
  group by item_id, doc_id
)
select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
from scored where score > 0
qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10
"""
