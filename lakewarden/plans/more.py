"""Further queries, each beside its DuckDB SQL: request shaping, trust, audit, tools, evaluation, functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.functions import expressions as X
from lakewarden.operators import audit, decide, evaluate, names, requests, retrieval, tools, trust
from lakewarden.operators.staged import staged
from lakewarden.plans import tables as T
from lakewarden.plans.oracles import _LINE
from lakewarden.sources import readers, writers
from lakewarden.streaming import stateful

QUERIES: dict[str, Callable[..., DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(build):
        QUERIES[build.__name__], ORACLES[build.__name__] = build, sql
        return build

    return add


def queries() -> dict:
    return dict(QUERIES)


def _events(spark, sf) -> DataFrame:
    return T.table(spark, sf, "events")


def _id() -> Column:
    return F.col("event_id")


# ---------------------------------------------------------------- requests


@query("select conv_id, turn, case when role = 'tool' or turn % 5 = 4 then 'tool_result' else 'prompt' end as context from conversations")
def message_contexts(spark, sf):
    c = T.table(spark, sf, "conversations")
    role = F.when(F.col("turn") % 5 == 4, "tool").otherwise(F.col("role"))
    return c.select("conv_id", "turn", requests.message_context(role).alias("context"))


@query("select event_id, case when event_id % 5 in (0, 1) then 200 else 400 end as status from events")
def request_validity(spark, sf):
    bodies = ['{"messages":[{"role":"user","content":"x"}]}', '{"messages":[{"role":"user"},{"role":"tool","a":1}],"b":2}', '{"messages":[]}', '{"messages":[{"content":"x"}]}', "no json"]
    body = F.element_at(F.array(*map(F.lit, bodies)), (_id() % 5 + 1).cast("int"))
    return _events(spark, sf).select("event_id", requests.request_status(body).alias("status"))


@query("""select event_id, case event_id % 4 when 0 then 'm1' when 1 then 'big' when 2 then 'm1' end as model,
    case event_id % 4 when 0 then 'local-a' when 1 then 'cloud-b' when 2 then 'local-a' end as provider from events""")
def model_resolution(spark, sf):
    asked = F.element_at(F.array(*[F.lit(x).cast("string") for x in ("default", "big", None, "nope")]), (_id() % 4 + 1).cast("int"))
    m = decide.resolve_model(asked, T.policy())
    return _events(spark, sf).select("event_id", m["model"].alias("model"), m["provider"].alias("provider"))


@query("select model, place, (select count(*) from events) as n from (values ('m1', 1), ('m2', 2), ('big', 3)) v(model, place)")
def visible_models(spark, sf):
    models = F.array(*map(F.lit, decide.visible_models(T.policy())))
    rows = _events(spark, sf).select(F.posexplode(models).alias("place", "model"))
    return rows.groupBy("model", (F.col("place") + 1).alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, case when event_id % 2 = 0 then 'a=1,traceparent=t' else 'a=1' end as body, 'traceparent=t' as headers from events")
def forwarded_parts(spark, sf):
    body = F.create_map(*[F.lit(x) for x in ("a", "1", "messages", "m", "tools", "t", "function_call", "f")])
    body = F.when(_id() % 2 == 0, F.map_concat(body, F.create_map(F.lit("traceparent"), F.lit("t")))).otherwise(body)
    headers = F.create_map(*[F.lit(x) for x in ("Traceparent", "t", "X-Internal-Role", "r", "Authorization", "b")])
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ",")
    return _events(spark, sf).select("event_id", flat(requests.forwarded_body(body)).alias("body"), flat(requests.forwarded_headers(headers)).alias("headers"))


@query("""with e as (select event_id, event_id % 6 as k, event_id % 4 as u from events
    ), c as (select *, case when k = 1 then 401 when k in (0, 2) then case when k = 2 then 401 else 200 end
        when u = 3 then 503 when u = 2 then 401 else 200 end as status from e)
    select event_id, status, case when status = 401 then 'invalid_token' when status = 503 then 'auth_unavailable' end as code,
      case when status <> 200 then null when k = 0 then 'user:sub' when u = 1 then 'user:u' || event_id else 'client:c' || (k % 2) end as subject,
      case when status = 200 and k = 0 and event_id % 5 = 0 then 'crawler' when status = 200 and event_id % 5 = 0 then 'crawler' end as agent from c""")
def request_identity(spark, sf):
    clients = _events(spark, sf).select((_id() % 2).cast("string").alias("k")).distinct().select(F.concat(F.lit("c"), "k").alias("client"), F.sha2(F.concat(F.lit("key"), "k"), 256).alias("key_sha256"))
    k = _id() % 6
    rows = _events(spark, sf).select(
        "event_id",
        F.when(k == 0, "Bearer a.b.c").when(k == 1, "Basic x").when(k == 2, "bearer a.b").otherwise(F.concat(F.lit("bearer key"), (k % 2).cast("string"))).alias("authorization"),
        F.when(_id() % 5 == 0, "crawler").otherwise("other").alias("agent"),
        F.lit("sub").alias("oidc_sub"),
        F.concat(F.lit("u"), _id().cast("string")).alias("user_sub"),
        F.element_at(F.array(*map(F.lit, ("absent", "valid", "invalid", "unconfigured"))), (_id() % 4 + 1).cast("int")).alias("user_token"),
    )
    return requests.identify(rows, clients, ["crawler"]).select("event_id", "status", "code", "subject", "agent")


@query("""select event_id, case when event_id % 3 = 0 then md5(event_id::varchar) else md5('trace:' || event_id) end as trace_id,
    case when event_id % 3 = 0 then '00f067aa0ba902b7' end as parent_id, substr(md5('span:' || event_id), 1, 16) as span_id from events""")
def trace_continuation(spark, sf):
    header = F.when(_id() % 3 == 0, F.concat(F.lit("00-"), F.md5(_id().cast("string")), F.lit("-00f067aa0ba902b7-01"))).when(_id() % 3 == 1, "00-" + "0" * 32 + "-00f067aa0ba902b7-01")
    return _events(spark, sf).select("event_id", requests.trace_context(header, _id()).alias("t")).select("event_id", "t.trace_id", "t.parent_id", "t.span_id")


@query("""select event_id, 'data: ' || case when event_id % 7 = 0 then '[DONE]' else event_type end as line,
    case when event_id % 7 <> 0 then event_type end as content from events where event_id % 3 <> 2""")
def sse_lines(spark, sf):
    """Lines of event streams: chunks, closing lines, comments and broken JSON; those that carry anything."""
    json = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("event_type").alias("content")).alias("delta"))).alias("choices")))
    line = F.when(_id() % 3 == 2, F.when(_id() % 2 == 0, ": ping").otherwise("data: {")).when(_id() % 7 == 0, "data: [DONE]").otherwise(F.concat(F.lit("data: "), json))
    p = readers.sse_payload(line)
    content = F.from_json(p["json"], "choices array<struct<delta:struct<content:string>>>")["choices"][0]["delta"]["content"]
    rows = _events(spark, sf).select("event_id", p["done"].alias("done"), content.alias("content")).where("done is not null")
    return rows.select("event_id", F.concat(F.lit("data: "), F.when(F.col("done"), "[DONE]").otherwise(F.col("content"))).alias("line"), "content")


@query("""select event_id, event_id % 10 < 6 as found from events""")
def context_lookups(spark, sf):
    e = _events(spark, sf)
    made = e.where(_id() % 10 < 8).select(_id().alias("request_id"), F.col("ts").cast("timestamp").alias("created"))
    wait = F.when(_id() % 10 < 6, 599).otherwise(600)
    asked = e.select("event_id", _id().alias("request_id"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + wait * 1_000_000).alias("at"))
    return decide.context_lookup(made, asked).select("event_id", "found")


# ---------------------------------------------------------------- tools


@query("select event_id, case when event_id % 2 = 0 then 'lookup,lookup' else 'search' end as kept, case when event_id % 2 = 0 then 1 else 2 end as dropped from events")
def requested_tools(spark, sf):
    asked = decide.strings(["lookup", "search", "lookup"])
    allowed = F.when(_id() % 2 == 0, decide.strings(["lookup"])).otherwise(decide.strings(["search", "x"]))
    t = decide.split_tools(asked, allowed)
    return _events(spark, sf).select("event_id", F.array_join(t["kept"], ",").alias("kept"), t["dropped"].alias("dropped"))


@query("select event_id, event_type in ('view', 'click') as permitted, case when event_type not in ('view', 'click') then 'tool.call.denied' end as audit_event from events")
def permitted_calls(spark, sf):
    rows = _events(spark, sf).select("event_id", F.col("event_type").alias("tool"))
    return tools.split_calls(rows, decide.strings(["view", "click"])).select("event_id", "permitted", "audit_event")


@query("""with f as (select user_id, event_id, first_value(case when event_id % 3 <> 0 then event_type end ignore nulls) over
      (partition by user_id order by event_id rows between unbounded preceding and unbounded following) as name from events)
    select user_id as request_id, event_id as chunk_no from f where name in ('view', 'click')""")
def streamed_tool_filter(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("request_id"), _id().alias("chunk_no"), F.when(_id() % 3 != 0, F.col("event_type")).alias("name"))
    return tools.filter_fragments(rows, decide.strings(["view", "click"]), ["request_id"]).select("request_id", "chunk_no")


@query("""with c as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1) // 2 as round from events),
    u as (select user_id, count(distinct round) filter (round < 4) as rounds from c group by 1)
    select event_id, round < 4 as ran, rounds, least(rounds, 4) as answered_in from c join u using (user_id)""")
def tool_loop(spark, sf):
    place = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    rows = _events(spark, sf).select(F.col("user_id").alias("request_id"), "event_id", F.floor(place / 2).cast("int").alias("round"))
    return tools.tool_rounds(rows, 5).select("event_id", "ran", "rounds", "answered_in")


@query("select event_id, event_id % 4 = 0 as ok from events")
def tool_arguments(spark, sf):
    schema = {"properties": {"ticket": {"type": "string", "pattern": "^T-[0-9]+$"}, "n": {"type": "integer"}}, "required": ["ticket"], "additionalProperties": False}
    body = F.concat(F.lit('{"ticket":"T-'), _id().cast("string"), F.lit('"'), F.element_at(F.array(*map(F.lit, (',"n":3}', ',"n":"3"}', ',"x":1}', "x"))), (_id() % 4 + 1).cast("int")))
    return _events(spark, sf).select("event_id", tools.arguments_ok(body, schema).alias("ok"))


@query("select event_id, case when event_id % 3 = 0 then 200 else 404 end as status_code from events")
def confirmation_owner(spark, sf):
    e = _events(spark, sf)
    held = e.where(_id() % 3 != 2).select(_id().alias("confirmation_id"), F.col("user_id").alias("subject"))
    asked = e.select("event_id", _id().alias("confirmation_id"), (F.col("user_id") + (_id() % 3)).alias("subject"))
    return tools.owned(held, asked).select("event_id", "status_code")


@query("select event_id, case when event_id % 2 = 0 then 413 when event_id % 3 = 0 then 401 when event_id % 5 = 0 then 403 end as status, "
       "case when event_id % 2 = 0 then 'too_large' when event_id % 3 = 0 then 'invalid_token' when event_id % 5 = 0 then 'policy_denied' end as code from events")
def failure_codes(spark, sf):
    code = X.failure_code([(_id() % 2 == 0, 413, "too_large"), (_id() % 3 == 0, 401, "invalid_token"), (_id() % 5 == 0, 403, "policy_denied")])
    return _events(spark, sf).select("event_id", code["status"].alias("status"), code["code"].alias("code"))


# ---------------------------------------------------------------- audit and trust


@query(f"""select count(*) as entries, 'sha256:' || sha256(arg_max({_LINE}, event_id)) as head, 2 * count(*) filter (event_id % 50 = 0) as findings, false as ok from events""")
def audit_report(spark, sf):
    """A report over two lists of findings of which each is named twice."""
    lines = T.log_lines(spark, sf)
    a = lines.where("line_no % 50 = 0").select("seg", F.lit("gap").alias("kind"), F.col("line_no").alias("line"))
    b = lines.where("line_no % 50 = 0").select(F.lit("worm_extra").alias("kind"), F.col("line_no").cast("string").alias("key"))
    return audit.report([a, b, a, b], lines)[1]


@query("""select count(*) as entries, count(*) filter (event_id % 3 = 0) as without_policy, count(*) filter (event_id % 4 = 0 and event_id % 5 <> 0) as without_trace,
    count(*) filter (event_id % 5 <> 0 and event_id % 2 = 0 and event_id % 7 = 0) as without_proof from events""")
def audit_hygiene(spark, sf):
    """Audit lines by event: some lack the policy, the trace or a part of the proof of egress."""
    named = F.when(_id() % 5 == 0, "boot").when(_id() % 2 == 0, "egress.cloud").otherwise("request.accepted")
    fields = {
        "event": named,
        "trace_id": F.when(_id() % 4 != 0, F.md5(_id().cast("string"))),
        "policy": F.struct(F.when(_id() % 3 != 0, "1").alias("version"), F.lit("d").alias("digest")),
        "rule_ids": F.array(F.lit("r")),
        "provider": F.lit("p"),
        "payload_sha256": F.when(_id() % 7 != 0, "h"),
    }
    lines = _events(spark, sf).select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("raw_line"))
    return audit.hygiene(lines)


@query("""select event_id, '{"event":"' || event_type || '","id":' || event_id || case when event_id % 2 = 0 then ',"tool":"t"' else '' end || '}' as line
    from events where event_type in ('view', 'purchase')""")
def audit_lines(spark, sf):
    """Lines of the events that are switched on, with the fields that may enter the log and without absent ones."""
    e = audit.enabled_events(_events(spark, sf), ["view", "purchase"], "event_type")
    fields = audit.allowed_fields(F.create_map(F.lit("tool"), F.when(_id() % 2 == 0, "t"), F.lit("secret"), F.lit("s")), ["tool"])
    line = F.to_json(F.struct(F.col("event_type").alias("event"), _id().alias("id"), F.try_element_at(fields, F.lit("tool")).alias("tool")))
    return e.select("event_id", line.alias("line"))


@query("""with l as (select '{"event":"audit","id":' || event_id || '}' as line from events)
    select line, count(*) as n from l group by 1""")
def appended_log(spark, sf):
    """Audit lines written to a text log and read back."""
    lines = _events(spark, sf).select(writers.audit_line("audit", {"id": _id()}).alias("line"))
    log = staged(lines, "log")
    return log.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("""with m as (select event_id, '<110>1 2024-01-01T00:00:00Z host audit - - - ' || event_type as m from events)
    select event_id, strlen(m) || ' ' || m as frame from m""")
def syslog_frames(spark, sf):
    return _events(spark, sf).select("event_id", audit.syslog_frame(F.col("event_type"), F.lit(1_704_067_200), "host").alias("frame"))


@query("select event_id, 'keyring-state/' || sha256(event_type || event_id) as key, 'entries/' || lpad(event_id::varchar, 20, '0') as mirror from events")
def object_keys(spark, sf):
    return _events(spark, sf).select("event_id", writers.keyring_key(F.concat("event_type", _id().cast("string"))).alias("key"), writers.mirror_key("entries", _id()).alias("mirror"))


@query("""with p as (select 'k' || (event_id // 3) as key, case when event_id % 7 = 0 then 'x' else 'b' end as body from events
    ), held as (select 'k' || event_id as key, 'b' as body from events where event_id % 2 = 0
    ), w as (select p.key, p.body, coalesce(h.body, min(p.body) over (partition by p.key)) as winner, h.body is not null as had,
        row_number() over (partition by p.key order by p.body) as n from p left join held h using (key)
    ), o as (select case when body <> winner then 'conflict' when not had and n = 1 then 'created' else 'same' end as outcome from w)
    select outcome, count(*) as n from o group by 1""")
def mirror_puts(spark, sf):
    e = _events(spark, sf)
    held = e.where(_id() % 2 == 0).select(F.concat(F.lit("k"), _id().cast("string")).alias("key"), F.lit("b").alias("body"))
    rows = e.select(F.concat(F.lit("k"), F.floor(_id() / 3).cast("string")).alias("key"), F.when(_id() % 7 == 0, "x").otherwise("b").alias("body"))
    return evaluate.outcome_summary(audit.put_objects(held, rows))


@query("""with l as (select user_id as seg, ts from events), w as (select seg, time_bucket(interval 1 hour, ts) + interval 1 hour as due_at, count(*) as entries from l group by 1, 2)
    select seg, strftime(due_at, '%Y-%m-%d %H:%M:%S') as due_at, entries, ceil(entries / 2)::bigint as checkpoints from w""")
def checkpoint_times(spark, sf):
    rows = _events(spark, sf).select(F.col("user_id").alias("seg"), F.col("ts").cast("timestamp").alias("at"))
    due = stateful.checkpoints_due(rows, 2, 3600)
    return due.select("seg", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss").alias("due_at"), "entries", "checkpoints")


@query("""with r as (select s_nationkey as history, row_number() over (partition by s_nationkey order by s_suppkey) as n, s_suppkey as k from supplier
    ), v as (select history, case when k % 7 = 0 then n + 1 else n end as version, 'd' || k as digest, k, n from r
    ), p as (select *, case when n = 1 then case when k % 5 = 0 then 'x' else '' end when k % 3 = 0 then 'bad' else lag(digest) over (partition by history order by n) end as prev,
        k % 4 as valid from v
    ), o as (select *, lag(version) over (partition by history order by version, digest) as v0, lag(digest) over (partition by history order by version, digest) as d0 from p)
    select history, version, count(*) as n from o group by 1, 2""")
def ring_versions(spark, sf):
    """Ring histories, some with a jump; how many rings each version has (ties are told apart by digest)."""
    s = T.table(spark, sf, "supplier")
    n = F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey"))
    k = F.col("s_suppkey")
    rows = s.select(F.col("s_nationkey").alias("history"), F.when(k % 7 == 0, n + 1).otherwise(n).alias("version"), F.concat(F.lit("d"), k.cast("string")).alias("digest"))
    rows = rows.withColumn("prev", F.lit("")).withColumn("valid", F.lit(1)).withColumn("need", F.lit(1))
    return trust.successions(rows).groupBy("history", "version").agg(F.count(F.lit(1)).alias("n"))


@query("""with r as (select s_nationkey as history, row_number() over (partition by s_nationkey order by s_suppkey) as n, s_suppkey as k from supplier
    ), p as (select *, lag('d' || k) over (partition by history order by n) as d0,
        case when n = 1 then case when k % 5 = 0 then 'x' else '' end when k % 3 = 0 then 'bad' else lag('d' || k) over (partition by history order by n) end as prev from r)
    select history, n as version, case when n = 1 and prev <> '' then 'bad_genesis' when n > 1 and prev is distinct from d0 then 'wrong_predecessor'
      when k % 4 = 0 then 'no_quorum' end as fault from p""")
def ring_faults(spark, sf):
    s = T.table(spark, sf, "supplier")
    line = W.partitionBy("s_nationkey").orderBy("s_suppkey")
    k, n = F.col("s_suppkey"), F.row_number().over(line)
    digest = F.concat(F.lit("d"), k.cast("string"))
    prev = F.when(n == 1, F.when(k % 5 == 0, "x").otherwise("")).when(k % 3 == 0, "bad").otherwise(F.lag(digest).over(line))
    rows = s.select(F.col("s_nationkey").alias("history"), n.alias("version"), digest.alias("digest"), prev.alias("prev"), (k % 4).alias("valid"), F.lit(1).alias("need"))
    return trust.successions(rows)


@query("""select s_nationkey % 5 as version, count(distinct s_suppkey) filter (s_suppkey % 13 <> 0 and s_suppkey % 2 = 0) as keyring_keys,
      count(distinct s_suppkey) filter (s_suppkey % 13 <> 0) as policy_keys,
      count(distinct s_suppkey) filter (s_suppkey % 13 <> 0 and s_suppkey % 2 = 0) >= 2 and count(distinct s_suppkey) filter (s_suppkey % 13 <> 0) >= 6 as ok from supplier group by 1""")
def ring_workable(spark, sf):
    k = F.col("s_suppkey")
    roles = F.when(k % 2 == 0, decide.strings(["policy", "keyring"])).otherwise(decide.strings(["policy"]))
    keys = T.table(spark, sf, "supplier").select(
        (F.col("s_nationkey") % 5).alias("version"), k.cast("string").alias("id"), roles.alias("roles"), (k % 13 == 0).alias("revoked"),
        F.timestamp_seconds(F.lit(0)).alias("not_before"), F.timestamp_seconds(F.lit(100)).alias("not_after"),
    )
    return trust.workable(keys, F.timestamp_seconds(F.lit(50)), 2, 6)


@query("""select s_nationkey as subject, count(distinct s_suppkey) filter (s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0) as kept,
    count(distinct s_suppkey) filter (s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0) >= 2 as ok from supplier group by 1""")
def retained_signers(spark, sf):
    s = T.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    old = s.select(F.col("s_nationkey").alias("subject"), k.alias("id"), F.concat(F.lit("f"), k.cast("string")).alias("fingerprint"))
    new = s.select(
        k.alias("id"), F.concat(F.lit("f"), F.when(k % 3 == 0, -k).otherwise(k).cast("string")).alias("fingerprint"), decide.strings(["policy"]).alias("roles"),
        (k % 5 == 0).alias("revoked"), F.timestamp_seconds(F.lit(0)).alias("not_before"), F.timestamp_seconds(F.lit(100)).alias("not_after"),
    )
    return trust.retained(old, new, "policy", F.timestamp_seconds(F.lit(50)), 2)


@query("""with last as (select distinct o_custkey as digest, max(o_orderkey) over (partition by o_custkey) as seq from orders order by seq desc limit 5)
    select o_orderkey, o_custkey in (select digest from last) as known from orders""")
def policy_binding(spark, sf):
    o = T.table(spark, sf, "orders")
    log = o.select(F.col("o_custkey").alias("digest"), F.col("o_orderkey").alias("seq"))
    return decide.bound_to_policy(o.select(F.col("o_custkey").alias("digest"), "o_orderkey"), log).select("o_orderkey", "known")


@query("""select o_orderkey as owner, o_custkey as ref from orders where o_custkey not in (select c_custkey from customer where c_custkey % 4 <> 0)""")
def policy_references(spark, sf):
    """References of a large policy table that name nothing."""
    refs = T.table(spark, sf, "orders").select(F.col("o_orderkey").alias("owner"), F.lit("role").alias("kind"), F.col("o_custkey").alias("ref"))
    ids = T.table(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.lit("role").alias("kind"), F.col("c_custkey").alias("id"))
    return decide.unknown_references(refs, ids).select("owner", "ref")


# ---------------------------------------------------------------- evaluation and reports


@query("select event_type, round_even(avg(event_id % 100), 2) as mean_ms, quantile_disc(event_id % 100, 0.95) as p95_ms from events group by 1")
def latency_by_type(spark, sf):
    return evaluate.latency(_events(spark, sf).withColumn("ms", _id() % 100), by=("event_type",))


@query("""select event_type as reason, count(distinct event_id % 1000) as n, (select count(*) from events) as sentences,
    (select count(distinct event_id % 1000) from events) as triggered, round_even((select count(distinct event_id % 1000) from events) / (select count(*) from events), 3) as share
    from events group by 1""")
def trigger_statistics(spark, sf):
    e = _events(spark, sf)
    return evaluate.trigger_stats(e.select(F.lit(0).alias("id"), (_id() % 1000).alias("sid"), F.col("event_type").alias("reason")), e)


@query("select case o_orderkey % 4 when 0 then 'passed' when 1 then 'failed' when 2 then 'skipped' else 'passed' end as outcome, count(*) as n from orders group by 1")
def outcome_counts(spark, sf):
    k = F.col("o_orderkey") % 4
    return evaluate.outcome_summary(T.table(spark, sf, "orders").select(F.when(k == 1, "failed").when(k == 2, "skipped").otherwise("passed").alias("outcome")))


@query("select 'K2' as label, 'brightgreen' as color")
def level_badge(spark, sf):
    o = T.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    rows = o.select(F.concat(F.lit("K"), (k % 3 + 1).cast("string")).alias("level"), F.lit("MUST").alias("requirement"), F.when(k % 3 == 2, "failed").otherwise("passed").alias("outcome"))
    return writers.badge(evaluate.levels(rows, ["K1", "K2", "K3"]))


@query("select event_type || chr(9) || count(*) || chr(9) as line from events group by event_type")
def report_rows(spark, sf):
    rows = _events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("note", F.lit(None).cast("string"))
    return writers.report_lines(rows)


@query("""with v as (select vec_id, row_number() over (partition by label order by vec_id) as rank from embeddings) select vec_id, rank::int as rank from v where rank <= 3""")
def first_web_results(spark, sf):
    v = T.table(spark, sf, "embeddings")
    rows = v.select("vec_id", F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("rank"))
    return retrieval.first_results(rows, 3)


@query("""with recursive w as (select user_id as id, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 7200 as e, row_number() over (partition by user_id order by ts, event_id) as n from events
    ), m as (select *, max(e) over (partition by id order by s, e rows between unbounded preceding and 1 preceding) as before from w
    ), g as (select *, sum(case when before is null or s > before then 1 else 0 end) over (partition by id order by s, e rows unbounded preceding) as island from m
    ), u as (select id, island, min(s) as s, max(e) as e from g group by 1, 2
    ), c as (select id, e, unnest(range(s, e, 10000)) as s from u)
    select id, s, least(e, s + 10000) as e from c""")
def merged_windows(spark, sf):
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    return names.merge_windows(_events(spark, sf).select(F.col("user_id").alias("id"), at.alias("s"), (at + 7200).alias("e")), 10_000)


@query("""with w as (select distinct unnest(regexp_extract_all(text, '[A-Za-z]+')) as name from documents)
    select name from w where length(name) >= 4 and (lower(name) < 'm' or length(name) >= 7) and lower(name) not in ('aber', 'bitte', 'danke', 'eine', 'einen', 'einem',
      'einer', 'hallo', 'herr', 'herrn', 'frau', 'liebe', 'lieber', 'mein', 'meine', 'nach', 'nicht', 'noch', 'oder', 'sehr', 'sind', 'unter', 'wenn', 'team',
      'service', 'support', 'abteilung', 'kollegen', 'kolleginnen', 'zusammen')""")
def name_list(spark, sf):
    """A list of two: words of four letters of one half of the alphabet, of seven of the other."""
    w = T.table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("name"))
    return names.build_name_list([(w.where("lower(name) < 'm'"), 4), (w.where("lower(name) >= 'm'"), 7)])


# ---------------------------------------------------------------- functions


@query("""select event_id, event_id % 3 = 0 as ok, case event_id % 4 when 0 then event_id % 60 when 1 then (event_id % 60) * 60 when 2 then (event_id % 60) * 86400 end as seconds from events""")
def small_formats(spark, sf):
    """Account numbers made valid for every third row, and durations in three units and none."""
    body = F.lpad((_id() % 1_000_000).cast("string"), 18, "0")
    # Check digits of country DE: 98 less the remainder of body and 131400.
    rest = F.pmod(_id() % 1_000_000 * 1_000_000 + 131_400, F.lit(97))
    check = F.lpad((98 - rest).cast("string"), 2, "0")
    wrong = F.lpad(F.when(rest == 96, 3).otherwise(97 - rest).cast("string"), 2, "0")
    iban = F.concat(F.lit("de"), F.when(_id() % 3 == 0, check).otherwise(wrong), F.lit(" "), body)
    unit = F.element_at(F.array(*map(F.lit, ("s", "m", "d", "x"))), (_id() % 4 + 1).cast("int"))
    return _events(spark, sf).select("event_id", X.iban_ok(iban).alias("ok"), X.duration_seconds(F.concat((_id() % 60).cast("string"), unit)).alias("seconds"))


@query("""select event_id, '{"a":' || event_id || ',"b":"' || event_type || '"}' as canonical, sha256('{"a":' || event_id || ',"b":"' || event_type || '"}') as digest from events""")
def canonical_forms(spark, sf):
    text = F.concat(F.lit('{ "b" : "'), F.col("event_type"), F.lit('", "a" : '), _id().cast("string"), F.lit(" }"))
    return _events(spark, sf).select("event_id", X.canonical_json(text).alias("canonical"), F.sha2(X.canonical_json(text), 256).alias("digest"))


@query("select event_id, 'SHA256:' || rtrim(to_base64(unhex(sha256(event_type))), '=') as fingerprint, event_id % 2 = 0 as zoned from events")
def fingerprints(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(_id() % 4 == 0, "Z").when(_id() % 2 == 0, "+02:00").otherwise(""))
    return _events(spark, sf).select("event_id", X.fingerprint(F.col("event_type")).alias("fingerprint"), X.strict_timestamp(stamp).isNotNull().alias("zoned"))
