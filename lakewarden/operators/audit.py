"""Audit logs: hash chains, Merkle roots, checkpoints, the mirror and their verification.

A log is a set of rows ``seg, line_no, raw_line``: a segment is one chain with its own
genesis, and lines are ordered within it. Chains of different segments are built and
checked in parallel; within one, only neighbours are compared.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakewarden.operators.ordered import BoundedQueue, folded
from lakewarden.operators.staged import staged

#: What verification reports of a log (kinds and texts are compared by its readers).
GENESIS = "sha256:" + "0" * 64
_FINDING = ["seg", "kind", "line", "detail"]


def line_hash(line: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(line, 256))


def link_lines(log: DataFrame, seg: str = "seg", order: str = "line_no", line: str = "raw_line") -> DataFrame:
    """``log`` with ``prev_hash``: the hash of the line before, or the genesis value."""
    before = F.lag(line_hash(F.col(line))).over(W.partitionBy(seg).orderBy(order))
    return log.withColumn("prev_hash", F.coalesce(before, F.lit(GENESIS)))


def classify_chain(log: DataFrame) -> DataFrame:
    """Findings ``seg, kind, line, detail`` of a log whose lines are JSON with ``seq`` and ``prev_hash``.

    A sequence number other than the line's place is a gap if no line has the place's
    number and it runs ahead, else a reorder. A wrong link is a modification of the line
    before if no line has that hash, a reorder if one has, else a broken chain.
    """
    own = W.partitionBy("seg").orderBy("line_no")
    parsed = log.select(
        "seg",
        F.row_number().over(own).cast("long").alias("line"),
        line_hash(F.col("raw_line")).alias("hash"),
        F.try_parse_json("raw_line").alias("j"),
    )
    parsed = parsed.select(
        "seg",
        "line",
        "hash",
        F.col("j").isNotNull().alias("json"),
        F.try_variant_get("j", "$.seq", "long").alias("seq"),
        F.try_variant_get("j", "$.prev_hash", "string").alias("got"),
    ).withColumn("prev", F.coalesce(F.lag("hash").over(W.partitionBy("seg").orderBy("line")), F.lit(GENESIS)))
    known = parsed.select("seg", F.col("hash").alias("got"), F.lit(True).alias("known")).distinct()
    seqs = parsed.where("seq is not null").select("seg", F.col("seq").alias("line"), F.lit(True).alias("present")).distinct()
    rows = parsed.join(known, ["seg", "got"], "left").join(seqs, ["seg", "line"], "left")
    not_json = rows.where(~F.col("json")).select("seg", F.lit("modified").alias("kind"), "line", F.lit("line is not JSON").alias("detail"))
    off = rows.where(F.col("json") & (F.col("seq") != F.col("line")))
    gap = F.col("present").isNull() & (F.col("seq") > F.col("line"))
    order = off.select("seg", F.when(gap, "gap").otherwise("reorder").alias("kind"), "line", F.format_string("seq %d, expected %d", "seq", "line").alias("detail"))
    broken = rows.where(F.col("json") & ~F.col("got").eqNullSafe(F.col("prev")))
    lost = F.col("known").isNull() & (F.col("line") > 1)
    links = broken.select(
        "seg",
        F.when(lost, "modified").when(F.col("known"), "reorder").otherwise("chain_break").alias("kind"),
        F.when(lost, F.col("line") - 1).otherwise(F.col("line")).alias("line"),
        F.when(lost, F.lit("next prev_hash does not match this line"))
        .when(F.col("known"), F.lit("prev_hash matches a different line"))
        .otherwise(F.lit("prev_hash does not match the previous line"))
        .alias("detail"),
    )
    return not_json.unionByName(order).unionByName(links).select(_FINDING)


def _joined(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(b"\x01"), left, right), 256))


#: Levels of a tree that one grouped pass builds: blocks of 2**LEVELS nodes.
LEVELS = 7


def tree_nodes(leaves: DataFrame, seg: str = "seg", order: str = "line_no", body: str = "raw_line") -> DataFrame:
    """``seg, level, i, h``: every node of a log's hash tree that covers a full power of two of lines.

    Leaves are hashed with prefix 00 and pairs with 01. A pass groups ``2**LEVELS`` neighbours and
    builds all levels within such a block, so even one huge segment is hashed in parallel in
    few shuffles and no task holds more than a block; the driver only learns the height.
    """
    place = F.row_number().over(W.partitionBy(seg).orderBy(order)) - 1
    leaf = F.unhex(F.sha2(F.concat(F.lit(b"\x00"), F.encode(F.col(body), "UTF-8")), 256))
    base = staged(leaves.select(F.col(seg).alias("seg"), F.lit(0).alias("level"), place.cast("long").alias("i"), leaf.alias("h")), "tree")
    most = (base.agg(F.max("i")).first()[0] or 0) + 1
    nodes, height = base, 0

    def pairs(level: Column) -> Column:
        whole = F.floor(F.size(level) / 2).cast("int")
        return F.transform(F.sequence(F.lit(1), F.greatest(whole, F.lit(1))), lambda k: F.when(whole > 0, _joined(level[2 * k - 2], level[2 * k - 1])))

    def grow(levels: Column, _: Column) -> Column:
        return F.concat(levels, F.array(F.filter(pairs(F.element_at(levels, -1)), lambda h: h.isNotNull())))

    while most > 1:
        block = base.groupBy("seg", F.shiftright("i", LEVELS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("p"))
        hashes = F.array(F.transform("p", lambda x: x["h"]))
        grown = block.select("seg", "block", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), hashes, grow).alias("levels"))
        rows = grown.select("seg", "block", F.posexplode("levels").alias("up", "hs")).where("up > 0")
        rows = rows.select("seg", "block", "up", F.posexplode("hs").alias("k", "h"))
        rows = rows.select("seg", (F.lit(height) + F.col("up")).alias("level"), (F.call_function("shiftleft", F.col("block"), F.lit(LEVELS) - F.col("up")) + F.col("k")).cast("long").alias("i"), "h")
        made = staged(rows, "tree")
        nodes = nodes.unionByName(made)
        height += LEVELS
        base = made.where(F.col("level") == height)
        most = most >> LEVELS
    return nodes


def prefix_roots(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``seg, entries, root`` of the first ``entries`` lines, for wanted rows ``seg, entries``.

    A prefix is the full subtrees that the binary digits of its length name, joined from the
    last; so a root needs as many nodes as the length has ones, found by an equi join.
    """
    one = wanted.select("seg", F.col("entries").cast("long").alias("entries")).where("entries > 0").distinct()
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.getbit(F.col("entries"), k) == 1)
    parts = one.select("seg", "entries", F.explode(bits).alias("level"))
    # The subtree of a digit starts after those of all higher digits.
    parts = parts.withColumn("i", F.expr("shiftleft(shiftright(entries, level + 1), 1)"))
    found = parts.join(nodes, ["seg", "level", "i"]).groupBy("seg", "entries").agg(F.array_sort(F.collect_list(F.struct("level", "h"))).alias("p"))
    rest = F.slice("p", F.lit(2), F.size("p"))
    root = F.aggregate(rest, F.col("p")[0]["h"], lambda low, x: _joined(x["h"], low))
    return found.select("seg", "entries", F.concat(F.lit("sha256:"), F.lower(F.hex(root))).alias("root"))


def merkle_roots(leaves: DataFrame, seg: str = "seg", order: str = "line_no", body: str = "raw_line") -> DataFrame:
    """``seg, entries, root``: SHA-256 trees with prefixes 00 and 01; an odd node moves up unchanged."""
    nodes = tree_nodes(leaves, seg, order, body)
    return prefix_roots(nodes, nodes.where("level = 0").groupBy("seg").agg(F.count(F.lit(1)).alias("entries")))


class MerkleRoot:
    """A grouped aggregate for logs that fit in a task: ``merkle_root(place, line)`` as a pandas function.

    ``log.groupBy("seg").agg(merkle_root("line_no", "raw_line"))``; larger logs use ``merkle_roots``.
    """

    @staticmethod
    def of(lines: list[bytes]) -> str:
        level = [hashlib.sha256(b"\x00" + x).digest() for x in lines] or [hashlib.sha256(b"").digest()]
        while len(level) > 1:
            pairs = [hashlib.sha256(b"\x01" + a + b).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(level) & ~1 :]
        return "sha256:" + level[0].hex()


@F.pandas_udf(StringType())
def merkle_root(place: pd.Series, line: pd.Series) -> str:
    order = place.sort_values(kind="stable").index
    return MerkleRoot.of([x.encode() for x in line.loc[order]])


#: The root of a log without entries.
EMPTY_ROOT = "sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def checkpoint_rows(log: DataFrame, every: int) -> DataFrame:
    """Lines at which a checkpoint is due: every ``every`` entries of a segment."""
    place = F.row_number().over(W.partitionBy("seg").orderBy("line_no"))
    return log.withColumn("entries", place.cast("long")).where(F.col("entries") % every == 0)


def verify_checkpoints(checkpoints: DataFrame, log: DataFrame, mirrored: DataFrame | None = None) -> DataFrame:
    """Findings of checkpoints ``seg, seq, entries, head, merkle_root, prev_checkpoint, body_hash, signature_ok`` against a log.

    Copies of one envelope count once, in order of ``seq``. One with a bad signature or without
    entries is forged and not looked at further. Of the others, a sequence that does not rise is a
    reorder, a link to another predecessor a gap, more entries than the log has a truncation, and
    a head or root over the covered prefix that differs from the log's a modification. With
    ``mirrored`` (``seg, body_hash``, what the mirror holds) a checkpoint that only
    lies beside the log is missing there.
    """
    once = checkpoints.dropDuplicates(["seg", "body_hash", "signature_ok"])
    good = F.coalesce("signature_ok", F.lit(False)) & (F.coalesce("entries", F.lit(0)) > 0) & F.col("seq").isNotNull()
    order = W.partitionBy("seg").orderBy("seq", "body_hash")
    checked = once.where(good).withColumn("before", F.lag("body_hash").over(order)).withColumn("seq_before", F.lag("seq").over(order))
    lines = log.select("seg", F.row_number().over(W.partitionBy("seg").orderBy("line_no")).cast("long").alias("entries"), line_hash(F.col("raw_line")).alias("is_head"))
    sizes = log.groupBy("seg").agg(F.count(F.lit(1)).alias("lines"))
    roots = prefix_roots(tree_nodes(log), checked.select("seg", "entries")).withColumnRenamed("root", "is_root")
    checked = checked.join(lines, ["seg", "entries"], "left").join(sizes, "seg", "left").join(roots, ["seg", "entries"], "left")
    if mirrored is not None:
        held = mirrored.select("seg", "body_hash", F.lit(True).alias("held")).distinct()
        checked = checked.join(held, ["seg", "body_hash"], "left")
    covered = F.col("entries") <= F.coalesce("lines", F.lit(0))
    cases = [
        (F.col("seq") <= F.col("seq_before"), "reorder", "checkpoint sequence does not rise"),
        (F.coalesce("prev_checkpoint", F.lit(GENESIS)) != F.coalesce("before", F.lit(GENESIS)), "gap", "checkpoint does not link to the one before"),
        (~covered, "truncation", "checkpoint covers more entries than the log"),
        (covered & ~(F.col("head").eqNullSafe(F.col("is_head")) & F.col("merkle_root").eqNullSafe(F.col("is_root"))), "modified", "head or root differs from the log"),
    ]
    if mirrored is not None:
        cases.append((F.col("held").isNull(), "worm_missing", "checkpoint is not in the mirror"))
    found = F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(d).alias("detail"))) for c, k, d in cases])
    rows = checked.select("seg", F.col("seq").alias("line"), F.explode_outer(F.filter(found, lambda x: x.isNotNull())).alias("f")).where("f is not null")
    forged = once.where(~good).select("seg", F.lit("forged_checkpoint").alias("kind"), F.col("seq").alias("line"), F.lit("bad signature, sequence or entries").alias("detail"))
    return rows.select("seg", "f.kind", "line", "f.detail").unionByName(forged).select(_FINDING)


def mirror_diff(log: DataFrame, mirror: DataFrame, markers: DataFrame) -> DataFrame:
    """Findings ``kind, key`` of a versioned mirror: extra, mismatch, missing (tail: truncation), delete markers.

    log: ``key, body``; mirror: ``key, version_id, body``; an object is right only if
    every version equals the log's body. Missing keys that form the log's tail are a
    truncation of the mirror, others are gaps. One pass over log and mirror together gives
    each key its flags; the findings are exploded from them.
    """
    sides = log.select("key", F.col("body").alias("own"), F.lit(None).cast("string").alias("held")).unionByName(
        mirror.select("key", F.lit(None).cast("string").alias("own"), F.col("body").alias("held"))
    )
    both = sides.groupBy("key").agg(F.max("own").alias("own"), F.min("held").alias("least"), F.max("held").alias("most"))
    both = staged(both.select("key", *[F.col(c).isNotNull().alias(n) for c, n in (("own", "logged"), ("least", "held"))], F.coalesce((F.col("least") != F.col("own")) | (F.col("most") != F.col("own")), F.lit(False)).alias("differs")), "mirror")
    last = both.where("logged and held").agg(F.max("key")).first()[0]
    tail = F.lit(True) if last is None else F.col("key") > F.lit(last)
    kind = (
        F.when(~F.col("logged"), "worm_extra")
        .when(F.col("differs"), "worm_mismatch")
        .when(~F.col("held"), F.when(tail, "truncation").otherwise("worm_missing"))
    )
    gone = markers.where(F.col("key").startswith("entries/") | F.col("key").startswith("checkpoints/")).select(F.lit("delete_marker").alias("kind"), "key").distinct()
    return both.select(kind.alias("kind"), "key").where("kind is not null").unionByName(gone)


def put_objects(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent puts ``key, body``: ``key, body, outcome, write``.

    A body that the store has, or that an equal row of the batch puts first, is ``same``; another
    body for a key that is taken is a ``conflict``. Of different bodies for one new key in a batch
    the least creates it. ``write`` marks the one row of each new key that is to be stored.
    """
    held = existing.groupBy("key").agg(F.min("body").alias("held"))
    n = F.row_number().over(W.partitionBy("key").orderBy("body"))
    first = F.first("body").over(W.partitionBy("key").orderBy("body"))
    rows = incoming.select("key", "body", n.alias("n"), first.alias("first")).join(held, "key", "left")
    winner = F.coalesce("held", "first")
    state = (
        F.when(~F.col("body").eqNullSafe(winner), "conflict")
        .when(F.col("held").isNull() & (F.col("n") == 1), "created")
        .otherwise("same")
    )
    out = rows.select("key", "body", state.alias("outcome"))
    return out.withColumn("write", F.col("outcome") == "created")


def _findings(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.distinct()


def report(findings: list[DataFrame], log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every different finding, and one row ``entries, head, findings, ok`` for the log's single segment."""
    rows = _findings(findings)
    n = rows.agg(F.count(F.lit(1)).alias("findings"))
    head = F.coalesce(line_hash(F.max_by("raw_line", "line_no")), F.lit(GENESIS))
    verdict = log.agg(F.count(F.lit(1)).alias("entries"), head.alias("head")).crossJoin(F.broadcast(n)).withColumn("ok", F.col("findings") == 0)
    return rows, verdict


def hygiene(entries: DataFrame, prefixes: tuple[str, ...] = ("request.", "route.", "tool.", "egress.")) -> DataFrame:
    """One row of counts over audit lines ``raw_line``: entries, and those that lack what they must carry.

    Every entry needs a policy version and digest, one about a request a trace id of 32
    hexadecimal digits, one about cloud egress its rules, provider, policy and payload hash.
    """
    j = F.try_parse_json("raw_line")
    text = lambda path: F.try_variant_get(j, path, "string")
    event = F.coalesce(text("$.event"), F.lit(""))
    has = lambda path: F.coalesce(text(path) != "", F.lit(False))
    full = lambda path: F.coalesce(~text(path).isin("", "[]", "{}"), F.lit(False))
    about = reduce(lambda a, b: a | b, [event.startswith(p) for p in prefixes])
    proof = full("$.rule_ids") & full("$.provider") & full("$.policy") & full("$.payload_sha256")
    return entries.agg(
        F.count(F.lit(1)).alias("entries"),
        F.count_if(~(has("$.policy.version") & has("$.policy.digest"))).alias("without_policy"),
        F.count_if(about & ~F.coalesce(text("$.trace_id").rlike("^[0-9a-f]{32}$"), F.lit(False))).alias("without_trace"),
        F.count_if((event == "egress.cloud") & ~proof).alias("without_proof"),
    )


def enabled_events(events: DataFrame, enabled: list[str], event: str = "event") -> DataFrame:
    """Only events that the policy has switched on are written."""
    return events.where(F.col(event).isin(enabled))


def allowed_fields(fields: Column, allowed: list[str]) -> Column:
    """A map of an outer service's fields cut to those that may enter the log."""
    return F.map_filter(fields, lambda k, _: k.isin(allowed))


def queue_admission(events: DataFrame, limit: int, sinks: tuple[str, ...], key: str = "queue") -> DataFrame:
    """Replay of bounded queues: puts are refused when one is full; an item leaves when all sinks have acknowledged it.

    events: ``key, n, kind`` (put or ack), ``item, sink`` in order ``n``; adds ``depth`` and
    ``refused``. Nothing is dropped.
    """
    rows = events.withColumn("__at", F.col("n").cast("long"))
    return folded(rows, [key], "__at", ["n"], BoundedQueue(limit, sinks)).drop("__at")


def syslog_frame(message: Column, seconds: Column, host: str, facility: int = 13, severity: int = 6, app: str = "audit") -> Column:
    """RFC 5424 over TCP: octet count, blank, message."""
    stamp = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    line = F.concat(F.lit(f"<{facility * 8 + severity}>1 "), stamp, F.lit(f" {host} {app} - - - "), message)
    return F.concat(F.octet_length(line).cast("string"), F.lit(" "), line)
