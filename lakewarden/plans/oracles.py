"""DuckDB SQL for the registered queries."""

from __future__ import annotations

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_IP = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
_TOKEN = r'token = "([0-9a-f]{40})"'

# Card-like runs: whole digit runs of 12 to 19 with no letter after them, outside tokens, passing Luhn.
_CARDS = rf"""
cardruns as (
  select doc_id, unnest(regexp_extract_all(regexp_replace(text, '{_TOKEN}', '#', 'g'), '[0-9]+[A-Za-z]?')) as v from documents
), cards as (
  select doc_id, v as value from cardruns
  where regexp_full_match(v, '[0-9]{{12,19}}')
    and list_sum(list_transform(range(1, len(v) + 1), lambda i: case when i % 2 = 1 then reverse(v)[i]::int
        when reverse(v)[i]::int > 4 then 2 * reverse(v)[i]::int - 9 else 2 * reverse(v)[i]::int end)) % 10 = 0
)"""

_ENTITIES = rf"""
entities as (
  select d.doc_id, d.lang, d.source, 'EMAIL' as entity, len(regexp_extract_all(text, '{_EMAIL}')) as n from documents d
  union all select doc_id, lang, source, 'IP', len(regexp_extract_all(text, '{_IP}')) from documents
  union all select doc_id, lang, source, 'SECRET', len(regexp_extract_all(text, '{_TOKEN}')) from documents
  union all select d.doc_id, lang, source, 'CARD', count(c.value) from documents d join cards c using (doc_id) group by all
)"""

_SUBJECTS = f"""
{_CARDS}, {_ENTITIES}, named as (
  select doc_id, string_agg(entity, ',' order by entity) as entities from entities where n > 0 group by 1
), subjects as (
  select d.doc_id as request_id, coalesce(entities, '') as entities,
         source in ('src0', 'src1', 'src2') as editor, lang in ('en', 'de') as reader,
         doc_id % 2 = 0 as crawler, doc_id % 3 = 0 as m1
  from documents d left join named using (doc_id)
), classed as (
  select *, case when entities like '%SECRET%' then 4 when entities like '%CARD%' then 3 when entities <> '' then 2 when editor or reader then 1 else 0 end as rank
  from subjects
), decided as (
  select *, ['open', 'team', 'personal', 'payment', 'credential'][rank + 1] as data_class,
    case when rank = 4 then 'no-credentials' when rank = 3 and editor then 'payments-by-editors' when rank in (2, 3) and m1 then 'private-on-m1'
         when rank <= 1 and editor and crawler then 'crawled' when reader then 'readers' when not m1 then 'rest-on-m2' end as rule_id,
    array_to_string(list_filter([case when editor and crawler and rank <= 3 then 'lookup' end, case when editor and crawler and rank <= 1 then 'comment' end,
      case when reader and rank <= 2 then 'search' end], lambda x: x is not null), ',') as tools,
    array_to_string(list_filter([case when editor then 'docs' end, case when editor or reader then 'handbook' end], lambda x: x is not null), ',') as collections,
    editor and rank <= 1 as web_search
  from classed
), routed as (
  select *, case coalesce(rule_id, 'no-credentials') when 'no-credentials' then 'deny' when 'crawled' then 'cloud-allowed'
    when 'readers' then 'local-with-cloud-fallback' else 'local-only' end as mode
  from decided
)"""

_EMAIL_SPANS = rf"""
parts as (
  select doc_id, text, regexp_extract_all(text, '{_EMAIL}') as ms, string_split_regex(text, '{_EMAIL}') as segs from documents
), numbered as (select *, unnest(range(1, len(ms) + 1)) as i from parts where len(ms) > 0
), emails as (
  select doc_id, ms[i] as value,
    (list_sum(list_transform(segs[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::bigint as s
  from numbered
), email_spans as (select doc_id, s, s + len(value) as e, value from emails)"""

_LINE = """'{"event":"' || event_type || '","id":' || event_id || '}'"""
_GENESIS = "sha256:" + "0" * 64

_NAMES = r"""
words as (
  select lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as name from documents where lang = 'en'
), freq as (select name, count(*) as n from words group by 1
), given as (select name from freq where n >= 50 and len(name) % 2 = 0
), surnames as (select name from freq where n >= 50 and len(name) % 2 = 1)"""

ORACLES: dict[str, str] = {
    "detect_email_spans": f"with {_EMAIL_SPANS} select doc_id, s, e, value from email_spans",
    "detect_card_luhn": f"with {_CARDS.replace(chr(35), chr(35))} select doc_id, value from cards",
    "detect_secret_tokens": f"select doc_id, unnest(regexp_extract_all(text, '{_TOKEN}', 1)) as value from documents",
    "entity_counts_by_lang": f"with {_CARDS}, {_ENTITIES} select lang, entity, sum(n)::bigint as n from entities where n > 0 group by 1, 2",
    "entity_rollup": f"with {_CARDS}, {_ENTITIES} select lang, source, entity, sum(n)::bigint as n from entities where n > 0 group by rollup (lang, source, entity)",
    
    "mask_web_results": f"""select page_id, len(regexp_extract_all(html, '{_EMAIL}'))::bigint as hits,
        regexp_replace(html, '{_EMAIL}', '<EMAIL_REDACTED>', 'g') as masked from pages""",
    "strip_placeholders": "select conv_id, turn, role || ' asks now' as query, 2::bigint as removed, false as empty from conversations",
    "roles_for_claims": """select doc_id as request_id, array_to_string(list_filter([case when source in ('src0', 'src1', 'src2') then 'editor' end,
        case when lang in ('en', 'de') then 'reader' end], lambda x: x is not null), ',') as roles from documents""",
    "data_class_assign": f"with {_SUBJECTS} select request_id, entities, data_class, rank from routed",
    "route_first_match": f"""with {_SUBJECTS} select request_id, rule_id, case rule_id when 'no-credentials' then 70 when 'payments-by-editors' then 60
        when 'private-on-m1' then 55 when 'crawled' then 40 when 'readers' then 20 else 5 end as priority, mode from routed where rule_id is not null""",
    "route_trace": f"""with {_SUBJECTS}, steps as (
          select request_id, rule_id,
            ['no-credentials:' || case when rank = 4 then 'match' else 'data_class' end,
             'payments-by-editors:' || case when rank = 3 and editor then 'match' else concat_ws(',', case when rank <> 3 then 'data_class' end, case when not editor then 'roles' end) end,
             'private-on-m1:' || case when rank in (2, 3) and m1 then 'match' else concat_ws(',', case when rank not in (2, 3) then 'data_class' end, case when not m1 then 'model' end) end,
             'crawled:' || case when rank <= 1 and editor and crawler then 'match' else concat_ws(',', case when rank > 1 then 'data_class' end,
               case when not editor then 'roles' end, case when not crawler then 'agent' end) end,
             'readers:' || case when reader then 'match' else 'roles' end, 'rest-on-m2:' || case when not m1 then 'match' else 'model' end] as s,
            case rule_id when 'no-credentials' then 1 when 'payments-by-editors' then 2 when 'private-on-m1' then 3 when 'crawled' then 4 when 'readers' then 5 else 6 end as upto
          from routed)
        select request_id, array_to_string(s[1:upto], ';') as trace from steps""",
    "request_decision": f"""with {_SUBJECTS} select request_id, data_class, rank, coalesce(rule_id, '') as rule_id, mode,
        case when mode = 'deny' then 403 else 200 end as status, tools, collections, web_search from routed""",
    "allowed_tools": f"with {_SUBJECTS} select request_id, tools from routed",
    "allowed_collections": """select doc_id as request_id, array_to_string(list_filter([case when source in ('src0', 'src1', 'src2') then 'docs' end,
        case when source in ('src0', 'src1', 'src2') or lang in ('en', 'de') then 'handbook' end], lambda x: x is not null), ',') as collections from documents""",
    "web_permission": f"with {_SUBJECTS} select data_class, web_search, count(*) as n from routed group by 1, 2",
    "provider_permission": f"""with {_SUBJECTS} select request_id, case when mode = 'deny' then 'policy_denied'
        when crawler and mode = 'local-only' then 'mode' else '' end as reason from routed""",
    "body_size_checks": """with b as (select event_id, case when event_id % 7 = 0 then 'not json' else props end as body from events)
        select event_id, case when strlen(body) > 12 then 413 when json_valid(body) and json_type(body) = 'OBJECT' then 200 else 400 end as status from b""",
    "egress_recheck": "select doc_id as msg_idx, 0::bigint as hits from documents",
    "rate_limit_admission": """with recursive e as (
          select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events
        ), walk as (
          select user_id, event_id, n, true as admitted, [t] as buf from e where n = 1
          union all
          select e.user_id, e.event_id, e.n, len(list_filter(w.buf, lambda x: x > e.t - 3600000000)) < 2,
            case when len(list_filter(w.buf, lambda x: x > e.t - 3600000000)) < 2
                 then list_append(list_filter(w.buf, lambda x: x > e.t - 3600000000), e.t) else w.buf end
          from walk w join e on e.user_id = w.user_id and e.n = w.n + 1
        )
        select user_id, event_id, admitted from walk""",
    "confirmation_states": """with recursive e as (
          select user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n, event_id % 3 = 0 as rejects,
                 event_id % 5 <> 0 as allowed, event_id % 7 <> 0 as args_ok, event_id % 11 <> 0 as succeeds from events
        ), w as (
          select user_id, n, t as created, 'pending' as status, 202 as code from e where n = 1
          union all
          select e.user_id, e.n, w.created,
            case when w.status <> 'pending' then w.status when e.t > w.created + 86400000000 then 'expired' when rejects then 'rejected'
                 when not (allowed and args_ok) then 'denied' when succeeds then 'executed' else 'failed' end,
            case when w.status <> 'pending' or e.t > w.created + 86400000000 then 409 when rejects then 200 when not allowed then 403 when not args_ok then 400 else 200 end
          from w join e on e.user_id = w.user_id and e.n = w.n + 1
        ), c as (select user_id, code, count(*) as k from w group by 1, 2)
        select w.user_id as confirmation_id, any_value(c.codes) as codes, arg_max(status, n) as status
        from w join (select user_id, string_agg(code || ':' || k, ',' order by code) as codes from c group by 1) c using (user_id) group by 1""",
    "tool_fragments": """select user_id as request_id, max_by(event_id::varchar, event_id) filter (event_id % 2 = 0) as call_id,
        string_agg(event_type, '' order by event_id) as arguments from events group by 1""",
    "tool_outcomes": """select case when event_id % 19 = 0 and event_id % 4 = 0 then 'web_search_not_permitted'
          when event_id % 19 <> 0 and event_id % 3 = 0 then 'tool_not_permitted' when event_id % 5 = 0 then 'invalid_arguments'
          when event_id % 2 = 0 and event_id % 7 = 0 then 'pending_confirmation' when event_id % 11 = 0 then 'rate_limited'
          when event_id % 13 = 0 then 'tool_gateway_unavailable' when event_id % 2 = 0 then 'tool_failed'
          when event_id % 17 = 0 then 'tool_result_unavailable' else 'executed' end as outcome, count(*) as n from events group by 1""",
    "stream_demask_batch": "select doc_id as request_id, 0 as choice, text from documents where text <> ''",
    "vector_topk_acl": """with v as (select vec_id, embedding::double[] as x, label from embeddings
        ), q as (select * from v where vec_id % 20 = 0
        ), scored as (
          select q.vec_id as query_id, v.vec_id, list_dot_product(q.x, v.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(v.x, v.x))) as score
          from q join v on v.label = q.label or v.label = (q.label + 1) % 10
        ), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
        select query_id, rank::int as rank, vec_id, round(score, 6) as score from ranked where rank <= 5""",
    "last_user_message": "select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'user' group by 1",
    "gazetteer_pairs": rf"""with {_NAMES}, t as (
          select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:-[\p{{L}}\p{{Nl}}\p{{No}}]+)*') as w,
                 string_split_regex(text, '[\p{{L}}\p{{Nl}}\p{{No}}]+(?:-[\p{{L}}\p{{Nl}}\p{{No}}]+)*') as g
          from documents
        ), rows_ as (
          select doc_id, unnest(range(1, len(w) + 1)) as i, w, g from t
        ), near as (
          select doc_id, replace(lower(w[i]), 'ß', 'ss') as a, replace(lower(w[i + 1]), 'ß', 'ss') as b, replace(lower(w[i + 2]), 'ß', 'ss') as c,
                 regexp_full_match(g[i + 1], '\s+') as g1, regexp_full_match(g[i + 2], '\s+') as g2, i + 2 <= len(w) as more
          from rows_ where i < len(w)
        ), picked as (
          select doc_id, a, case when b in ('von', 'van', 'de', 'da', 'del', 'di', 'zu') and more then case when g2 then c end else b end as surname from near where g1
        )
        select doc_id as id, count(*) as n from picked where a in (select name from given) and surname in (select name from surnames) group by 1""",
    "audit_chain": f"""select user_id as seg, event_id as line_no,
        coalesce('sha256:' || sha256(lag({_LINE}) over (partition by user_id order by event_id)), '{_GENESIS}') as prev_hash from events""",
    "worm_diff": f"""with log as (select event_id as i, {_LINE} as body, 'entries/' || lpad(event_id::varchar, 20, '0') as key, max(event_id) over () as most from events
        ), good as (select * from log where i % 97 <> 5 and i <= most - 10
        ), last as (select max(key) as k from good)
        select 'worm_mismatch' as kind, key from good where i % 89 = 3
        union all select 'worm_extra', 'other/' || key from log where i % 101 = 1
        union all select case when key > k then 'truncation' else 'worm_missing' end, key from log, last where i % 97 = 5 or i > most - 10
        union all select 'delete_marker', key from log where i % 83 = 2""",
    "keyring_validity": """select 'id' || s_suppkey as id, case when s_suppkey % 13 = 0 then 'revoked' when s_nationkey > 15 then 'not_yet_valid'
        when s_nationkey + 20 <= 15 then 'expired' else 'valid' end as state from supplier""",
    "quorum_status": """with k as (select *, s_suppkey % 13 = 0 as revoked, s_nationkey > 15 as early, s_suppkey % 4 = 0 as norole from supplier)
        select 'doc' || s_nationkey as subject, count(*) filter (s_suppkey % 17 <> 0 and s_suppkey % 19 <> 0 and s_suppkey % 23 <> 0 and not revoked and not early and not norole) as valid,
          3 as need, count(*) filter (s_suppkey % 17 <> 0 and s_suppkey % 19 <> 0 and s_suppkey % 23 <> 0 and not revoked and not early and not norole) >= 3 as ok
        from k group by 1""",
    "policy_rollback": """with b as (select o_custkey as history, o_orderkey % 3 <> 0 as signed, o_orderdate as d,
          max(o_orderdate) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding) as before from orders)
        select history, count(*) filter (signed and d < before) as refused from b group by 1""",
    "policy_last_valid": """select o_custkey as history, o_orderkey as seq,
        max(case when o_orderkey % 2 = 0 then o_orderkey end) over (partition by o_custkey order by o_orderkey)::varchar as active from orders""",
    "eval_by_vocab": f"""with {_EMAIL_SPANS} select doc_id % 2 = 0 as oov, count(*) as gold, count(*) filter ((doc_id + s) % 3 <> 0) as strict from email_spans group by 1""",
    "eval_p95": "select event_type, quantile_disc(value, 0.95) as p95, count(*) as n from events group by 1",
    "eval_gate": """with m as (select event_type as type, round_even(count(*) filter (event_id % 4 <> 0) / count(*), 3) as got from events group by 1)
        select type, got from m where got < 0.75 - 1e-9""",
    "conformance_levels": """with r as (select 'K' || (o_orderkey % 3 + 1) as level, o_orderkey % 2 = 0 as must, o_orderkey % 3 = 1 and o_orderkey % 1000 = 4 as failed from orders
        ), o as (select level, count(*) filter (must) > 0 and count(*) filter (must and failed) = 0 as own from r group by 1)
        select level, own, min(own::int) over (order by level) = 1 as reached from o""",
    "trace_ids": "select event_id, case when event_id % 5 <> 0 then md5(event_id::varchar) end as trace from events",
    "retention_expired": "select event_type, count(*) as n from events where ts < (select max(ts) from events) - interval 14 days group by 1",
    "event_window_counts": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by 1, 2",
}


def _offsets(name: str, pattern: str, skip: int = 0, drop: int = 0) -> str:
    """CTEs ``<name>_spans(doc_id, s, e, value)``; ``skip`` and ``drop`` cut the match at its ends."""
    return rf"""
{name}_parts as (
  select doc_id, text, regexp_extract_all(text, '{pattern}') as ms, string_split_regex(text, '{pattern}') as segs from documents
), {name}_rows as (select *, unnest(range(1, len(ms) + 1)) as i from {name}_parts where len(ms) > 0
), {name}_spans as (
  select doc_id, text, s + {skip} as s, s + len(v) - {drop} as e, substr(v, {skip} + 1, len(v) - {skip + drop}) as value from (
    select doc_id, text, ms[i] as v, (list_sum(list_transform(segs[1:i], lambda x: len(x)))
      + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: len(x))), 0))::bigint as s from {name}_rows)
)"""


_LUHN = """list_sum(list_transform(range(1, len(value) + 1), lambda i: case when i % 2 = 1 then reverse(value)[i]::int
  when reverse(value)[i]::int > 4 then 2 * reverse(value)[i]::int - 9 else 2 * reverse(value)[i]::int end)) % 10 = 0"""

_RESOLVED = f"""
{_offsets("em", _EMAIL)}, {_offsets("ipa", _IP)}, {_offsets("sec", _TOKEN, 9, 1)}, {_offsets("car", "[0-9]{12,19}")}, every as (
  select doc_id, s, e, value, 'EMAIL' as entity from em_spans
  union all select doc_id, s, e, value, 'IP' from ipa_spans
  union all select doc_id, s, e, value, 'SECRET' from sec_spans
  union all select doc_id, s, e, value, 'CARD' from car_spans where {_LUHN} and not regexp_matches(substr(text, e + 1, 1), '[A-Za-z0-9]')
), resolved as (
  select * from every a where not exists (
    select 1 from every b where b.doc_id = a.doc_id and b.s < a.e and a.s < b.e and b.e - b.s > a.e - a.s)
)"""

_BUILT = """
pieces as (
  select doc_id, s, e, text, mark, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from marked
), built as (
  select doc_id, string_agg(substr(text, prev + 1, s - prev) || mark, '' order by s) || substr(any_value(text), max(e) + 1) as masked from pieces group by 1
)"""

ORACLES |= {
    "mask_redact": f"""with {_RESOLVED}, marked as (select r.doc_id, s, e, d.text, '<' || entity || '_REDACTED>' as mark from resolved r join documents d using (doc_id)), {_BUILT}
        select doc_id, coalesce(masked, text) as masked from documents left join built using (doc_id)""",
    "mask_hash": f"""with {_RESOLVED}, marked as (select r.doc_id, s, e, d.text, '<' || entity || '_' || substr(sha256(value), 1, 10) || '>' as mark from resolved r join documents d using (doc_id)), {_BUILT}
        select doc_id, coalesce(masked, text) as masked from documents left join built using (doc_id)""",
    "placeholder_numbering": f"""with {_RESOLVED}, firsts as (
          select d.source as request_id, entity, value, min(doc_id * 1000000 + s) as f, count(*) as occurrences from resolved join documents d using (doc_id) group by all
        ), ranked as (select *, row_number() over (partition by request_id, entity order by f) as n from firsts)
        select request_id, entity, value, '<' || entity || '_' || n || '>' as placeholder, n, occurrences from ranked""",
    "demask_roundtrip": f"""with {_RESOLVED}, owned as (select r.*, d.source, d.text from resolved r join documents d using (doc_id)
        ), firsts as (select source, entity, value, min(doc_id * 1000000 + s) as f from owned where entity = 'SECRET' group by all
        ), numbered as (select *, '<SECRET_' || row_number() over (partition by source order by f) || '>' as mark from firsts
        ), marked as (select doc_id, s, e, text, mark from owned join numbered using (source, entity, value)), {_BUILT}
        select doc_id as msg_idx, coalesce(masked, text) as restored from documents left join built using (doc_id)""",
    "leak_scan": f"""with {_RESOLVED}, sensitive as (select distinct value from resolved),
        texts as (select html as t from pages union all select text from documents)
        select value, count(*) as n_texts from sensitive join texts on contains(t, value) group by 1""",
    "mask_delta": f"with {_RESOLVED} select doc_id as msg_idx, entity, count(*) as n from resolved group by all",
    "eval_metrics": f"""with {_RESOLVED}, gold as (select doc_id, s, case when (doc_id + s) % 3 = 0 then e + 1 else e end as e, e as pe, entity, text from (select r.doc_id, s, e, entity, d.text from resolved r join documents d using (doc_id))
        ), judged as (
          select entity as type, e = pe as strict, e > pe and length(text) > pe and regexp_matches(substr(text, pe + 1, 1), '[^\\s]')
            and not exists (select 1 from resolved o where o.doc_id = g.doc_id and o.s <= pe and o.e > pe) as more from gold g
        ), n as (select type, count(*) as gold, count(*) filter (strict) as strict, count(*) filter (not more) as masked, count(*) filter (more) as partial from judged group by 1)
        select type, gold, strict, masked, partial, gold as pred, gold as pred_ok, round_even(strict / gold, 3) as recall_strict,
          round_even(masked / gold, 3) as recall_masked, 1.0::double as precision from n""",
    "resolve_overlaps": f"with {_RESOLVED} select doc_id as request_id, s, e, entity from resolved",
    "mask_placeholder": f"""with {_RESOLVED}, owned as (select r.*, d.source, d.text from resolved r join documents d using (doc_id)
        ), firsts as (select source, entity, value, min(doc_id * 1000000 + s) as f from owned group by all
        ), marks as (select *, '<' || entity || '_' || row_number() over (partition by source, entity order by f) || '>' as mark from firsts
        ), pieces as (
          select doc_id, s, e, text, mark, coalesce(lag(e) over (partition by doc_id order by s), 0) as prev from owned join marks using (source, entity, value)
        ), built as (
          select doc_id, string_agg(substr(text, prev + 1, s - prev) || mark, '' order by s) || substr(any_value(text), max(e) + 1) as masked from pieces group by 1
        )
        select source as request_id, doc_id as msg_idx, coalesce(masked, text) as masked from documents left join built using (doc_id)""",
    "merkle_root": f"""with recursive t as (
          select user_id as seg, count(*) as entries, list(sha256(unhex('00') || encode({_LINE})) order by event_id) as h from events group by 1
        ), r as (
          select seg, entries, h from t
          union all
          select seg, entries, list_transform(range(1, (len(h) + 1) // 2 + 1),
            lambda i: case when 2 * i <= len(h) then sha256(unhex('01' || h[2 * i - 1] || h[2 * i])) else h[2 * i - 1] end) from r where len(h) > 1
        )
        select seg, entries, 'sha256:' || h[1] as root from r where len(h) = 1""",
    "checkpoint_verify": """with l as (select user_id as seg, row_number() over (partition by user_id order by event_id) as entries from events
        ), c as (select seg, entries // 20 as seq from l where entries % 20 = 0
        ), good as (select * from c where seg % 5 <> 0)
        select seg, 'forged_checkpoint' as kind, seq as line, 'bad signature, sequence or entries' as detail from c where seg % 5 = 0
        union all select seg, 'truncation', seq, 'checkpoint covers more entries than the log' from good where seg % 11 = 0 and seq = 1
        union all select seg, 'modified', seq, 'head or root differs from the log' from good
          where not (seg % 11 = 0 and seq = 1) and ((seg % 7 = 0 and seq = 2) or seg % 13 = 0)
        union all select seg, 'worm_missing', seq, 'checkpoint is not in the mirror' from good where seg % 17 = 0 and seq = 2""",
    "queue_backpressure": """with recursive e as (
          select user_id as queue, event_id as n, event_id % 3 = 0 as ack, event_id // 3 as item, event_id % 2 as sink,
                 row_number() over (partition by user_id order by event_id) as r from events
        ), w as (
          select queue, r, case when ack then [] else [item || ':0', item || ':1'] end as held, false as refused from e where r = 1
          union all
          select e.queue, e.r, case when e.ack then list_filter(w.held, lambda x: x <> e.item || ':' || e.sink)
              when not list_contains(list_transform(w.held, lambda x: split_part(x, ':', 1)), e.item::varchar)
                and len(list_distinct(list_transform(w.held, lambda x: split_part(x, ':', 1)))) >= 5 then w.held
              when list_contains(list_transform(w.held, lambda x: split_part(x, ':', 1)), e.item::varchar) then w.held
              else list_concat(w.held, [e.item || ':0', e.item || ':1']) end,
            not e.ack and not list_contains(list_transform(w.held, lambda x: split_part(x, ':', 1)), e.item::varchar)
              and len(list_distinct(list_transform(w.held, lambda x: split_part(x, ':', 1)))) >= 5
          from w join e on e.queue = w.queue and e.r = w.r + 1
        )
        select queue, count(*) filter (refused) as refused, max(len(list_distinct(list_transform(held, lambda x: split_part(x, ':', 1)))))::int as deepest from w group by 1""",
    "audit_chain_verify": f"""with recursive l as (
          select user_id as seg, row_number() over (partition by user_id order by event_id) as n, {_LINE} as raw from events
        ), chain as (
          select seg, n, '{_GENESIS}' as got, raw[:-2] || ',"prev_hash":"{_GENESIS}","seq":1}}' as line from l where n = 1
          union all
          select l.seg, l.n, 'sha256:' || sha256(c.line), l.raw[:-2] || ',"prev_hash":"sha256:' || sha256(c.line) || '","seq":' || l.n || '}}'
          from chain c join l on l.seg = c.seg and l.n = c.n + 1
        ), damaged as (
          select seg, n as seq, got, 'sha256:' || sha256(case when seg % 2 = 0 and n = 3 then replace(line, '"event":"', '"event":"x') else line end) as hash,
                 row_number() over (partition by seg order by n) as place
          from chain where not (seg % 3 = 0 and n = 5)
        ), linked as (
          select *, coalesce(lag(hash) over (partition by seg order by place), '{_GENESIS}') as prev,
            exists (select 1 from damaged k where k.seg = d.seg and k.hash = d.got) as known,
            exists (select 1 from damaged k where k.seg = d.seg and k.seq = d.place) as present
          from damaged d
        )
        select distinct seg, kind, line from (
          select seg, case when not present and seq > place then 'gap' else 'reorder' end as kind, place as line from linked where seq <> place
          union all
          select seg, case when not known and place > 1 then 'modified' when known then 'reorder' else 'chain_break' end,
                 case when not known and place > 1 then place - 1 else place end from linked where got <> prev
        )""",
}
