"""Signers and policy history: key validity, quorums, succession, rollback, last valid policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def key_state(at: Column) -> Column:
    """revoked, not_yet_valid, expired or valid at a time (start inclusive, end exclusive)."""
    return (
        F.when(F.col("revoked"), "revoked")
        .when(at < F.col("not_before"), "not_yet_valid")
        .when(at >= F.col("not_after"), "expired")
        .otherwise("valid")
    )


def signature_states(signatures: DataFrame, keys: DataFrame, role: str, at: Column) -> DataFrame:
    """Each signature's state against a keyring; of several valid ones of an identity all but the first are duplicates.

    signatures: ``subject, identity, fingerprint, crypto_ok``; keys: ``id, fingerprint,
    roles, not_before, not_after, revoked``.
    """
    joined = signatures.join(keys, "fingerprint", "left")
    state = (
        F.when(F.col("id").isNull(), "unknown")
        .when(F.col("id") != F.col("identity"), "identity_mismatch")
        .when(~F.array_contains("roles", role), "role")
        .when(key_state(at) != "valid", key_state(at))
        .when(~F.col("crypto_ok"), "bad_signature")
        .otherwise("valid")
    )
    rows = joined.withColumn("state", state)
    n = F.row_number().over(W.partitionBy("subject", "identity", "state").orderBy("fingerprint"))
    return rows.withColumn("state", F.when((F.col("state") == "valid") & (n > 1), "duplicate").otherwise(F.col("state"))).select(
        "subject", "identity", "fingerprint", "state"
    )


def quorums(states: DataFrame, threshold: int, raised: int = 0) -> DataFrame:
    """``subject, valid, need, ok``; a policy may raise the ring's threshold, never lower it."""
    need = F.lit(max(threshold, raised))
    valid = F.count_distinct(F.when(F.col("state") == "valid", F.col("identity")))
    return states.groupBy("subject").agg(valid.alias("valid")).select("subject", "valid", need.alias("need"), (F.col("valid") >= need).alias("ok"))


def workable(keys: DataFrame, at: Column, keyring_need: int, policy_need: int) -> DataFrame:
    """Whether enough valid keys of both roles remain, by ring version."""
    valid = key_state(at) == "valid"
    count = lambda role: F.count_distinct(F.when(valid & F.array_contains("roles", role), F.col("id")))
    out = keys.groupBy("version").agg(count("keyring").alias("keyring_keys"), count("policy").alias("policy_keys"))
    return out.withColumn("ok", (F.col("keyring_keys") >= keyring_need) & (F.col("policy_keys") >= policy_need))


def successions(rings: DataFrame, history: str = "history") -> DataFrame:
    """Faults of ring histories ``history, version, digest, prev, valid, need``: ``history, version, fault``.

    valid and need are the signers that count under the ring before (for the first, under itself).
    """
    order = W.partitionBy(history).orderBy("version")
    rows = rings.withColumn("v0", F.lag("version").over(order)).withColumn("d0", F.lag("digest").over(order))
    fault = (
        F.when(F.col("v0").isNull() & ((F.col("version") != 1) | (F.coalesce("prev", F.lit("")) != "")), "bad_genesis")
        .when(F.col("v0").isNotNull() & (F.col("version") != F.col("v0") + 1), "version_jump")
        .when(F.col("v0").isNotNull() & ~F.col("prev").eqNullSafe(F.col("d0")), "wrong_predecessor")
        .when(F.col("valid") < F.col("need"), "no_quorum")
    )
    return rows.select(history, "version", fault.alias("fault"))


def rollbacks(log: DataFrame, history: str = "history", order: str = "seq") -> DataFrame:
    """Activations ``history, seq, effective_from, signed``: a signed policy older than one before is refused."""
    before = F.max("effective_from").over(W.partitionBy(history).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return log.withColumn("refused", F.coalesce(F.col("signed") & (F.col("effective_from") < before), F.lit(False)))


def last_valid(log: DataFrame, history: str = "history", order: str = "seq") -> DataFrame:
    """The digest in force after each load attempt: a failed one leaves the last valid."""
    running = W.partitionBy(history).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return log.withColumn("active", F.last(F.when(F.col("valid"), F.col("digest")), ignorenulls=True).over(running))


def retained(old: DataFrame, new: DataFrame, role: str, at: Column, need: int) -> DataFrame:
    """Signers (``subject, id, fingerprint``) that still hold that key, role and validity; ``ok`` if enough do."""
    kept = new.where((key_state(at) == "valid") & F.array_contains("roles", role)).select("id", "fingerprint", F.lit(True).alias("kept"))
    joined = old.join(kept, ["id", "fingerprint"], "left")
    out = joined.groupBy("subject").agg(F.count_distinct(F.when(F.col("kept"), F.col("id"))).alias("kept"))
    return out.withColumn("ok", F.col("kept") >= need)
