"""Tool calls: fragments, argument checks, outcomes, rate limits and confirmations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.operators.ordered import OneDecision, SlidingLimit, folded


def assemble(fragments: DataFrame, keys: list[str], order: str = "chunk_no") -> DataFrame:
    """Names and arguments put together in chunk order; the id is the last one given."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("name", F.lit("")).alias("name"), F.coalesce("arguments", F.lit("")).alias("arguments"))))
    whole = lambda c: F.array_join(F.transform(F.col("parts"), lambda p: p[c]), "")
    out = fragments.groupBy(*keys).agg(parts.alias("parts"), F.max_by("call_id", F.when(F.col("call_id").isNotNull(), F.col(order))).alias("call_id"))
    return out.select(*keys, "call_id", whole("name").alias("name"), whole("arguments").alias("arguments"))


def filter_fragments(fragments: DataFrame, allowed: Column, keys: list[str], order: str = "chunk_no") -> DataFrame:
    """Keep fragments by the first named one's decision; later fragments follow it."""
    first = F.first("name", ignorenulls=True).over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = fragments.withColumn("__first", first)
    return rows.where(F.array_contains(allowed, F.col("__first"))).drop("__first")


def arguments_ok(arguments: Column, schema: dict) -> Column:
    """The subset of JSON Schema that tool definitions use: object, string properties, required, pattern, maxLength."""
    j = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    checks = [F.coalesce(F.schema_of_variant(j).startswith("OBJECT"), F.lit(False))]
    properties = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        checks.append(F.size(F.array_except(keys, F.array(*map(F.lit, properties)).cast("array<string>"))) == 0)
    for name in schema.get("required", ()):
        checks.append(F.array_contains(keys, name))
    for name, rule in properties.items():
        value = F.try_variant_get(j, f"$.{name}", "string")
        given = F.array_contains(keys, name)
        kind = F.schema_of_variant(F.try_variant_get(j, f"$.{name}", "variant"))
        ok = F.lit(True)
        if rule.get("type") == "string":
            ok = ok & F.coalesce(kind == "STRING", F.lit(False))
        if rule.get("type") == "integer":
            ok = ok & F.coalesce(kind == "BIGINT", F.lit(False))
        if "pattern" in rule:
            ok = ok & F.coalesce(value.rlike(rule["pattern"]), F.lit(False))
        if "maxLength" in rule:
            ok = ok & F.coalesce(F.length(value) <= rule["maxLength"], F.lit(False))
        checks.append(~given | ok)
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def outcome(calls: DataFrame, web_tool: str = "web_search") -> DataFrame:
    """``outcome`` of calls: the first step of the chain that stops, else executed.

    calls: ``tool, allowed, web_ok, args_ok, needs_confirmation, confirmed, admitted,
    gateway_up, failed, masked_ok``. Rates are checked only at execution.
    """
    c = F.col
    return calls.withColumn(
        "outcome",
        F.when((c("tool") == web_tool) & ~c("web_ok"), "web_search_not_permitted")
        .when((c("tool") != web_tool) & ~c("allowed"), "tool_not_permitted")
        .when(~c("args_ok"), "invalid_arguments")
        .when(c("needs_confirmation") & ~c("confirmed"), "pending_confirmation")
        .when(~c("admitted"), "rate_limited")
        .when(~c("gateway_up"), "tool_gateway_unavailable")
        .when(c("failed"), "tool_failed")
        .when(~c("masked_ok"), "tool_result_unavailable")
        .otherwise("executed"),
    )


def admit(calls: DataFrame, keys: list[str], limit: int, window_seconds: int, at: str = "at", number: str = "call_no") -> DataFrame:
    """Sliding-window rate limit: ``keys, call_no, at, admitted``; refused calls do not count.

    Admission depends on earlier admissions, so a key's calls pass a state machine in
    order of time and number; memory is its buffer of at most ``limit`` times.
    """
    rows = calls.select(*keys, number, F.unix_micros(at).alias("__micros"))
    out = folded(rows, keys, "__micros", [number], SlidingLimit(limit, window_seconds))
    return out.select(*keys, number, F.timestamp_micros("__micros").alias(at), "admitted")


def confirmations(events: DataFrame, key: str = "confirmation_id", lifetime_seconds: int = 900) -> DataFrame:
    """``key, n, code, status`` after each of the events ``key, n, at, action, allowed, args_ok, succeeds``."""
    rows = events.withColumn("__micros", F.unix_micros("at"))
    return folded(rows, [key], "__micros", ["n"], OneDecision(lifetime_seconds)).drop("__micros")


def final_states(steps: DataFrame, key: str = "confirmation_id") -> DataFrame:
    """The status after the last event, and how often each code was given (``code:times`` in order of code)."""
    by_code = steps.groupBy(key, "code").agg(F.count(F.lit(1)).alias("times"), F.max(F.struct("n", "status")).alias("last"))
    codes = F.array_sort(F.collect_list(F.struct("code", "times")))
    out = by_code.groupBy(key).agg(F.max("last").alias("last"), codes.alias("codes"))
    text = F.array_join(F.transform("codes", lambda c: F.concat_ws(":", c["code"].cast("string"), c["times"].cast("string"))), ",")
    return out.select(key, F.col("last.status").alias("status"), text.alias("codes"))


def owned(confirmations_: DataFrame, requests: DataFrame) -> DataFrame:
    """A foreign confirmation looks like an unknown one: both 404."""
    mine = confirmations_.select("confirmation_id", "subject", F.lit(True).alias("found"))
    return requests.join(mine, ["confirmation_id", "subject"], "left").withColumn("status_code", F.when(F.col("found"), 200).otherwise(404)).drop("found")


def tool_rounds(calls: DataFrame, max_rounds: int) -> DataFrame:
    """The tool loop of recorded requests: which calls ran and how each request ended.

    calls: ``request_id, round`` (from 0) and more. Tools are not offered in the last round, so
    calls in it or after it never run. Adds ``ran``; ``rounds`` and ``answered_in`` are the
    request's rounds with tools and the round of its answer.
    """
    ran = F.col("round") < max_rounds - 1
    used = calls.groupBy("request_id").agg(F.count_distinct(F.when(ran, F.col("round"))).alias("rounds"))
    used = used.withColumn("answered_in", F.least(F.col("rounds"), F.lit(max_rounds - 1)))
    return calls.withColumn("ran", ran).join(used, "request_id")


def split_calls(calls: DataFrame, allowed: Column, tool: str = "tool") -> DataFrame:
    """Every call with ``permitted`` and, for the others, the audit event that reports it."""
    ok = F.coalesce(F.array_contains(allowed, F.col(tool)), F.lit(False))
    return calls.withColumn("permitted", ok).withColumn("audit_event", F.when(~ok, "tool.call.denied"))
