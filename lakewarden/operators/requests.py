"""Requests as they come in and go out: contexts, validity, identity, what is forwarded."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.expressions import failure_code

#: Fields of a chat request that are rebuilt or withheld, never passed on as they came.
REBUILT = ("messages", "tools", "tool_choice", "functions", "function_call")
FORWARDED_HEADERS = ("traceparent",)


def message_context(role: Column) -> Column:
    """The masking context of a message: what a tool returned is ``tool_result``, all else ``prompt``."""
    return F.when(role == "tool", "tool_result").otherwise("prompt")


def request_status(body: Column) -> Column:
    """200, or 400 for a body whose ``messages`` is no list, is empty, or has a member without a role."""
    j = F.try_parse_json(body)
    kind = F.schema_of_variant(F.try_variant_get(j, "$.messages", "variant"))
    members = F.try_variant_get(j, "$.messages", "array<variant>")
    whole = (F.size(members) > 0) & F.forall(members, lambda m: F.array_contains(F.json_object_keys(m.cast("string")), "role"))
    good = F.coalesce(kind.startswith("ARRAY"), F.lit(False)) & F.coalesce(whole, F.lit(False))
    return F.when(good, 200).otherwise(400)


def forwarded_body(fields: Column) -> Column:
    """A request's top-level fields (a map) without those that are rebuilt."""
    return F.map_filter(fields, lambda k, _: ~k.isin(*REBUILT))


def forwarded_headers(headers: Column) -> Column:
    """The headers that leave the house: names are compared in lower case."""
    return F.map_filter(headers, lambda k, _: F.lower(k).isin(*FORWARDED_HEADERS))


def plain_content(parts: Column) -> Column:
    """``struct<text, ok>`` of a message's parts ``array<struct<type, text>>``: only texts can be masked."""
    ok = F.forall(parts, lambda p: p["type"] == "text")
    return F.struct(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("text"), F.coalesce(ok, F.lit(False)).alias("ok"))


def read_secret(reference: str | None) -> str | None:
    """What ``env:NAME`` or ``file:PATH`` refers to (on the driver); nothing for any other reference or an empty value."""
    kind, _, name = (reference or "").partition(":")
    if kind == "env":
        return os.environ.get(name) or None
    if kind == "file":
        try:
            return Path(name).read_text(encoding="utf-8").strip() or None
        except OSError:
            return None
    return None


def identify(requests: DataFrame, clients: DataFrame, agents: list[str]) -> DataFrame:
    """``requests`` with ``status, code, subject, client`` and ``agent`` set by the order of identity sources.

    requests: ``authorization, agent`` headers and what the token checks gave: ``oidc_sub`` (of a
    bearer token of three parts), ``user_sub`` (of a forwarded user token) and ``user_token``
    (absent, valid, invalid or unconfigured). clients: ``client, key_sha256``, the digests of the
    client keys. A client key comes first, then a signed token; a client's request is its user's if
    a user token is forwarded. An agent that is not listed is none.
    """
    bearer = F.lower(F.col("authorization")).startswith("bearer ")
    token = F.trim(F.substr("authorization", F.lit(8)))
    rows = requests.withColumn("__bearer", F.coalesce(bearer, F.lit(False)))
    rows = rows.withColumn("__token", F.when(F.col("__bearer"), token)).withColumn("__key", F.sha2("__token", 256))
    known = clients.groupBy(F.col("key_sha256").alias("__key")).agg(F.min("client").alias("client"))
    rows = rows.join(known, "__key", "left")
    three = F.size(F.split("__token", r"\.")) == 3
    state = F.coalesce("user_token", F.lit("absent"))
    bad = failure_code(
        [
            (~F.col("__bearer"), 401, "invalid_token"),
            (F.col("client").isNull() & ~F.coalesce(three & F.col("oidc_sub").isNotNull(), F.lit(False)), 401, "invalid_token"),
            (F.col("client").isNotNull() & (state == "unconfigured"), 503, "auth_unavailable"),
            (F.col("client").isNotNull() & (state == "invalid"), 401, "invalid_token"),
        ]
    )
    who = (
        F.when(F.col("client").isNull(), F.concat(F.lit("user:"), "oidc_sub"))
        .when(state == "valid", F.concat(F.lit("user:"), "user_sub"))
        .otherwise(F.concat(F.lit("client:"), "client"))
    )
    agent = F.when(F.col("agent").isin(agents), F.col("agent"))
    rows = rows.withColumn("__bad", bad)
    ok = F.col("__bad").isNull()
    return rows.select(
        *[c for c in requests.columns if c != "agent"],
        F.coalesce("__bad.status", F.lit(200)).alias("status"),
        F.col("__bad.code").alias("code"),
        F.when(ok, who).alias("subject"),
        F.when(ok, F.col("client")).alias("client"),
        F.when(ok, agent).alias("agent"),
    )


def trace_context(header: Column, request: Column) -> Column:
    """``struct<trace_id, parent_id, span_id, traceparent>``: a valid trace goes on, else one begins.

    New ids are hashes of the request's id, so a rerun gives the same ones.
    """
    low = F.lower(F.trim(header))
    pattern = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    trace, parent = (F.regexp_extract(low, pattern, i) for i in (1, 2))
    valid = F.coalesce((trace != "") & (trace != "0" * 32) & (parent != "0" * 16), F.lit(False))
    own = F.when(valid, trace).otherwise(F.md5(F.concat(F.lit("trace:"), request.cast("string"))))
    span = F.substr(F.md5(F.concat(F.lit("span:"), request.cast("string"))), F.lit(1), F.lit(16))
    flags = F.when(valid, F.regexp_extract(low, pattern, 3)).otherwise("01")
    return F.struct(own.alias("trace_id"), F.when(valid, parent).alias("parent_id"), span.alias("span_id"), F.concat_ws("-", F.lit("00"), own, span, flags).alias("traceparent"))
