"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_SHARDING = """
with keyed as (
  select doc_id, source, coalesce(strlen(text), 0) + 1 as size,
         hex(coalesce(text, '')) as b
  from documents
), bits as (
  select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tbl
), sums as (
  select doc_id, source, size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(b) // 2),
      lambda i: ('0x' || substr(b, 2 * i + 1, 2))::bigint)),
      lambda c, x: xor(c >> 8, tbl[xor(c & 255, x) + 1])), 4294967295) as text_crc32
  from keyed, bits
), crc as (
  select *, md5('17:' || coalesce(doc_id::varchar, '') || ':' || text_crc32) as k from sums
), first as (
  select *, row_number() over (partition by source order by k, doc_id, text_crc32, size) as r,
         count(*) over (partition by source) as n, count(*) over () as total
  from crc
), placed as (
  select *, row_number() over (order by (2 * r - 1) / (2.0 * n)::double, encode(source) nulls last, k, doc_id, text_crc32, size) - 1 as pos
  from first
), cut as (
  select *, (pos * 8) // total as s from placed
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'rows' as law, s::int as shard,
       (pos - (s * total + 7) // 8)::bigint as slot, null::int as grown_shard
from cut
"""

_MIXING = r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('29:' || coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, '')))), 1, 12))::bigint as h
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
         (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as weight
  from docs group by source
), levels as (
  select *, (sum(source_size) over () - 3.0 * coalesce(sum(source_size) over
      (order by source_size / weight, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))::double
    / sum(weight) over (order by source_size / weight, encode(source) nulls last rows between current row and unbounded following)
    as level
  from sources
), chosen as (
  select arg_min(level, source_size / weight) as level from levels where level * weight <= 3 * source_size
), plan as (
  select source, source_size, least(3.0 * source_size, chosen.level * weight)::double as target
  from levels, chosen
), budget as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from plan
), taken as (
  select d.doc_id, d.size, b.source_size, b.target, b.whole,
         floor(b.target - b.whole * b.source_size)::bigint as remaining,
         sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
         coalesce(sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and 1 preceding), 0) as prev
  from docs d join budget b on d.source is not distinct from b.source
)
select doc_id, size, source_size, target,
       ((whole + case when remaining > 0 and (upto <= remaining or (prev <= remaining and upto - remaining < remaining - prev)) then 1 else 0 end) * size)::bigint as taken
from taken
"""

_DECONTAMINATION = r"""
with docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), items as (
  select item_id::varchar as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), windows as (
  select item, least(len(w), 10) as size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
    lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as phrase
  from items where len(w) > 0
), sizes as (select distinct size from windows
), grams as (
  select doc_id, size, unnest(range(1, len(w) - size + 2)) as pos,
         unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as phrase
  from docs, sizes where len(w) >= size
), hits as (select doc_id, pos, g.size, item from grams g join windows using (size, phrase)
), covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(pos, pos + size)) as p from hits) group by 1
), named as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item from hits) group by 1
)
select d.doc_id, len(w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items,
       sha256(coalesce(m.ids, '')) as items_sha256, coalesce(c.n, 0) > 0 as contaminated
from docs d left join covered c using (doc_id) left join named m using (doc_id)
"""

_WARC = """
with payloads as (
  select page_id, coalesce(html, '') as body from pages
), digests as (
  select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as hx,
         min(page_id) over (partition by body) as first_id
  from payloads
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 4), lambda g: array_to_string(list_transform(range(0, 8),
         lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(hx, 10 * g + 1, 10))::bigint >> (35 - 5 * i)) & 31)::int + 1, 1)), '')), '') as payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end as record_type,
       case when page_id = first_id then null else first_id end as refers_to
from digests
"""

_MINHASH = r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w
  from documents
), grams as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) end)) as g
  from docs
), sizes as (select doc_id, count(*) as n from grams group by 1
), pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as c from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select u, v from pairs join sizes x on u = x.doc_id join sizes y on v = y.doc_id where 100 * c >= 85 * (x.n + y.n - c)
), sym as (select u, v from links union all select v, u from links
), reach as (
  select doc_id as origin, doc_id as node from docs
  union
  select r.origin, s.v from reach r join sym s on r.node = s.u
)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from docs d left join sizes s using (doc_id) join (select origin, min(node) as c from reach group by 1) m on m.origin = d.doc_id
"""

ORACLES: dict[str, str] = {"op2_warc": _WARC, "op3_minhash": _MINHASH, "op4_sharding": _SHARDING, "op5_decontamination": _DECONTAMINATION, "op6_mixing": _MIXING}
