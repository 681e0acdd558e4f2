"""Decisions by policy: roles, data class, route, tools, collections, web search, egress.

Policy tables are bounded by the policy file, so conditions compile to expressions over
each request's row: no join, no shuffle. ``route_by_join`` is the relational form for
rules that come as a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.operators.detect import span_rows
from lakewarden.operators.policy import Policy


def strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def any_of(values: Column, listed) -> Column:
    return F.coalesce(F.arrays_overlap(values, strings(listed)), F.lit(False))


def roles_for_claims(claims: Column, policy: Policy) -> Column:
    """Role ids in policy order; ``claims`` is ``map<string, array<string>>``. A missing claim matches nothing."""
    hits = [F.when(any_of(F.try_element_at(claims, F.lit(r["claim"])), r["any_of"]), F.lit(r["id"])) for r in policy.roles]
    return F.filter(F.array(*hits).cast("array<string>"), lambda r: r.isNotNull())


def data_class(entities: Column, roles: Column, policy: Policy, collections: Column | None = None) -> Column:
    """``struct<id, rank>``: the highest class that applies; ties keep the first declared; none gives the lowest."""
    lowest = min(policy.data_classes, key=lambda c: c["rank"])
    result = F.struct(F.lit(lowest["id"]).alias("id"), F.lit(lowest["rank"]).alias("rank"))
    # Highest rank is tested first, so the chain is built from its end.
    order = sorted(range(len(policy.data_classes)), key=lambda i: (policy.data_classes[i]["rank"], -i))
    for i in order:
        c = policy.data_classes[i]
        applies = F.lit(c["always"])
        for values, listed in ((entities, c["entities"]), (roles, c["roles"]), (collections, c["collections"])):
            if listed and values is not None:
                applies = applies | any_of(values, listed)
        result = F.when(applies, F.struct(F.lit(c["id"]).alias("id"), F.lit(c["rank"]).alias("rank"))).otherwise(result)
    return result


def _conditions(rule: dict, cls: Column, roles: Column, agent: Column, model: Column) -> list[tuple[str, Column]]:
    """Present conditions by name, in reporting order. A present but empty list never holds."""
    out = []
    for name, listed, holds in (
        ("data_class", rule["data_classes"], lambda v: F.coalesce(cls.isin(v), F.lit(False)) if v else F.lit(False)),
        ("roles", rule["roles"], lambda v: any_of(roles, v) if v else F.lit(False)),
        ("agent", rule["agents"], lambda v: F.coalesce(agent.isin(v), F.lit(False)) if v else F.lit(False)),
        ("model", rule["models"], lambda v: F.coalesce(model.isin(v), F.lit(False)) if v else F.lit(False)),
    ):
        if listed is not None:
            out.append((name, holds(listed)))
    return out


def route(cls: Column, roles: Column, agent: Column, model: Column, policy: Policy) -> Column:
    """``struct<id, priority, mode>`` of the first matching rule by priority; null without one."""
    result = F.lit(None).cast("struct<id:string,priority:int,mode:string>")
    for rule in reversed(policy.rules):
        matches = reduce(lambda a, b: a & b, [c for _, c in _conditions(rule, cls, roles, agent, model)], F.lit(True))
        own = F.struct(F.lit(rule["id"]).alias("id"), F.lit(rule["priority"]).alias("priority"), F.lit(rule["mode"]).alias("mode"))
        result = F.when(matches, own).otherwise(result)
    return result


def route_trace(cls: Column, roles: Column, agent: Column, model: Column, policy: Policy) -> Column:
    """``array<struct<rule, matched, reasons>>``: rules tried, up to and with the match."""
    tried, open_ = [], F.lit(True)
    for rule in policy.rules:
        parts = _conditions(rule, cls, roles, agent, model)
        matched = reduce(lambda a, b: a & b, [c for _, c in parts], F.lit(True))
        reasons = F.concat_ws(",", *[F.when(~c, F.lit(name)) for name, c in parts]) if parts else F.lit("")
        row = F.struct(F.lit(rule["id"]).alias("rule"), matched.alias("matched"), reasons.alias("reasons"))
        tried.append(F.when(open_, row))
        open_ = open_ & ~matched
    return F.filter(F.array(*tried), lambda r: r.isNotNull())


def route_by_join(requests: DataFrame, rules: DataFrame, key: str = "request_id") -> DataFrame:
    """First match by priority with rules as a table (``rules_table``): ``key, id, priority, mode`` of requests that have one.

    The rules, bounded by a policy file, gather in one row that is broadcast; each request
    looks through them by itself, so requests are neither multiplied nor shuffled.
    """
    fields = ["priority", "id", "mode", "data_classes", "roles", "agents", "models"]
    table = rules.agg(F.collect_list(F.struct(*fields)).alias("__rules"))

    def matches(r: Column) -> Column:
        def holds(listed: Column, value: Column, overlap: bool = False) -> Column:
            inside = F.arrays_overlap(listed, value) if overlap else F.array_contains(listed, value)
            return listed.isNull() | F.coalesce(inside, F.lit(False))

        return (
            holds(r["data_classes"], F.col("data_class"))
            & holds(r["roles"], F.col("roles"), True)
            & holds(r["agents"], F.col("agent"))
            & holds(r["models"], F.col("model"))
        )

    hits = F.transform(F.filter("__rules", matches), lambda r: F.struct(r["priority"].alias("priority"), r["id"].alias("id"), r["mode"].alias("mode")))
    found = requests.crossJoin(F.broadcast(table)).select(key, F.array_max(hits).alias("best"))
    return found.select(key, F.inline_outer(F.array("best"))).where("id is not null").select(key, "id", "priority", "mode")


def allowed_tools(roles: Column, agent: Column, rank: Column, policy: Policy) -> Column:
    """Tool ids in policy order. An empty agent list allows any agent."""
    hits = []
    for t in policy.tools:
        ok = any_of(roles, t["roles"]) & (rank <= t["max_rank"])
        if t["agents"]:
            ok = ok & F.coalesce(agent.isin(t["agents"]), F.lit(False))
        hits.append(F.when(ok, F.lit(t["id"])))
    return F.filter(F.array(*hits).cast("array<string>"), lambda t: t.isNotNull())


def allowed_collections(roles: Column, policy: Policy) -> Column:
    hits = [F.when(any_of(roles, c["roles"]), F.lit(c["id"])) for c in policy.collections]
    return F.filter(F.array(*hits).cast("array<string>"), lambda c: c.isNotNull())


def web_allowed(roles: Column, rank: Column, policy: Policy) -> Column:
    web = policy.web
    role_ok = any_of(roles, web["roles"]) if web["roles"] else F.lit(True)
    return F.lit(web["enabled"]) & role_ok & (rank <= web["max_rank"])


def provider_deny_reason(provider: Column, mode: Column, rule_id: Column, policy: Policy) -> Column:
    """Why a provider may not serve under the matched rule; null if it may."""
    kinds = F.create_map(*[F.lit(x) for p in policy.providers for x in (p["id"], p["type"])]) if policy.providers else F.create_map()
    kind = F.try_element_at(kinds, provider)
    local = F.create_map(*[x for r in policy.rules for x in (F.lit(r["id"]), strings(r["local"]))])
    cloud = F.create_map(*[x for r in policy.rules for x in (F.lit(r["id"]), strings(r["cloud"]))])
    own_local, own_cloud = F.try_element_at(local, rule_id), F.try_element_at(cloud, rule_id)
    return (
        F.when(rule_id.isNull() | (mode == "deny"), F.lit("policy_denied"))
        .when((kind == "cloud") & ~F.lit(policy.cloud_enabled), F.lit("cloud_disabled"))
        .when((kind == "cloud") & (mode == "local-only"), F.lit("mode"))
        .when((kind == "cloud") & ~F.coalesce(F.array_contains(own_cloud, provider), F.lit(False)), F.lit("provider"))
        .when((kind == "local") & (F.size(own_local) > 0) & ~F.array_contains(own_local, provider), F.lit("provider"))
        .when(kind.isNull(), F.lit("provider"))
    )


def resolve_model(requested: Column, policy: Policy) -> Column:
    """``struct<model, provider>``: an empty name means the first local model; unknown names are null."""
    models: dict[str, str] = {}
    for p in policy.providers:
        for m in p.get("models", ()):
            models.setdefault(m, p["id"])
    default = next((m for p in policy.providers if p["type"] == "local" for m in p.get("models", ())), None)
    name = F.when(requested.isNull() | requested.isin("", "default"), F.lit(default)).otherwise(requested)
    known = F.create_map(*[F.lit(x) for pair in models.items() for x in pair])
    provider = F.try_element_at(known, name)
    return F.when(provider.isNotNull(), F.struct(name.alias("model"), provider.alias("provider")))


def visible_models(policy: Policy) -> list[str]:
    """Local models, then cloud ones if enabled, each once."""
    kinds = ("local", "cloud") if policy.cloud_enabled else ("local",)
    return list(dict.fromkeys(m for k in kinds for p in policy.providers if p["type"] == k for m in p.get("models", ())))


def split_tools(requested: Column, allowed: Column) -> Column:
    """``struct<kept, dropped>``: requested tools that are allowed (repeats stay) and the number of others."""
    kept = F.filter(requested, lambda t: F.array_contains(allowed, t))
    return F.struct(kept.alias("kept"), (F.size(requested) - F.size(kept)).alias("dropped"))


def decide(requests: DataFrame, policy: Policy) -> DataFrame:
    """Class, route and permissions of rows ``entities, roles, agent, model``."""
    cls = data_class(F.col("entities"), F.col("roles"), policy)
    out = requests.withColumn("__class", cls)
    chosen = route(F.col("__class.id"), F.col("roles"), F.col("agent"), F.col("model"), policy)
    out = out.withColumn("__route", chosen)
    rank = F.col("__class.rank")
    return out.select(
        *requests.columns,
        F.col("__class.id").alias("data_class"),
        rank.alias("rank"),
        F.col("__route.id").alias("rule_id"),
        F.coalesce("__route.mode", F.lit("deny")).alias("mode"),
        F.when(F.coalesce("__route.mode", F.lit("deny")) == "deny", 403).otherwise(200).alias("status"),
        allowed_tools(F.col("roles"), F.col("agent"), rank, policy).alias("tools"),
        allowed_collections(F.col("roles"), policy).alias("collections"),
        web_allowed(F.col("roles"), rank, policy).alias("web_search"),
    )


def latest_policies(log: DataFrame, keep: int = 5) -> DataFrame:
    """The last ``keep`` distinct digests by activation order."""
    last = log.groupBy("digest").agg(F.max("seq").alias("seq"))
    return last.orderBy(F.desc("seq")).limit(keep)


def bound_to_policy(decisions: DataFrame, log: DataFrame, keep: int = 5) -> DataFrame:
    """Decisions ``digest, ...`` with ``known``: whether they name one of the last policies (``keep`` rows, broadcast)."""
    last = latest_policies(log, keep).select("digest", F.lit(True).alias("known"))
    return decisions.join(F.broadcast(last), "digest", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def unknown_references(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """References (``owner, kind, ref``) that name nothing in ``ids`` (``kind, id``)."""
    return refs.join(ids.withColumnRenamed("id", "ref"), ["kind", "ref"], "left_anti")


def entity_counts_by(found: DataFrame, *keys: str) -> DataFrame:
    """Masked occurrences (not distinct values) by keys and entity."""
    return span_rows(found, *keys).groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n"))


def context_lookup(requests: DataFrame, lookups: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """Whether a lookup finds its request before it expires: ``found`` false means 404."""
    joined = lookups.join(requests.select("request_id", "created"), "request_id", "left")
    age = F.unix_micros("at") - F.unix_micros("created")
    return joined.withColumn("found", F.coalesce((age >= 0) & (age < ttl_seconds * 1_000_000), F.lit(False))).drop("created")


def ordered_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
