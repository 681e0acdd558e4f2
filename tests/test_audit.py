"""Chains, trees, checkpoints, mirrors, signers and evaluation."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakewarden.operators import audit, evaluate, trust


def chain(n):
    lines, prev = [], audit.GENESIS
    for i in range(1, n + 1):
        line = json.dumps({"event": f"e{i}", "prev_hash": prev, "seq": i}, separators=(",", ":"))
        lines.append(line)
        prev = "sha256:" + hashlib.sha256(line.encode()).hexdigest()
    return lines


def findings(spark, lines):
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "seg string, line_no long, raw_line string")
    return sorted((r.kind, r.line) for r in audit.classify_chain(df).collect())


def test_chain_findings(spark):
    good = chain(6)
    assert findings(spark, good) == []
    edited = [x.replace('"e2"', '"ex"') if i == 1 else x for i, x in enumerate(good)]
    assert findings(spark, edited) == [("modified", 2)]
    assert findings(spark, good[:-1] + [good[-1].replace('"e6"', '"ex"')]) == []
    assert ("gap", 5) in findings(spark, good[:4] + good[5:]) or ("gap", 6) in findings(spark, good[:4] + good[5:])
    assert ("reorder", 3) in findings(spark, [*good[:2], good[3], good[2], *good[4:]])
    assert ("modified", 3) in findings(spark, [*good[:2], "no json", *good[3:]])


def tree(leaves):
    level = [hashlib.sha256(b"\x00" + x.encode()).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return "sha256:" + level[0].hex()


def test_merkle_roots_of_uneven_segments(spark):
    data = [(s, i, f"{s}-{i}") for s in range(1, 10) for i in range(s)]
    df = spark.createDataFrame(data, "seg int, line_no int, raw_line string")
    got = {r.seg: (r.entries, r.root) for r in audit.merkle_roots(df).collect()}
    assert got == {s: (s, tree([f"{s}-{i}" for i in range(s)])) for s in range(1, 10)}
    assert audit.EMPTY_ROOT == "sha256:" + hashlib.sha256(b"").hexdigest()


def test_mirror(spark):
    log = spark.createDataFrame([(f"entries/{i}", f"b{i}") for i in range(6)], "key string, body string")
    mirror = spark.createDataFrame([("entries/0", 1, "b0"), ("entries/1", 1, "b1"), ("entries/1", 2, "x"), ("entries/3", 1, "b3"), ("zz", 1, "q")], "key string, version_id int, body string")
    gone = spark.createDataFrame([("entries/0",), ("other",)], "key string")
    got = {(r.kind, r.key) for r in audit.mirror_diff(log, mirror, gone).collect()}
    assert got == {("worm_mismatch", "entries/1"), ("worm_missing", "entries/2"), ("truncation", "entries/4"), ("truncation", "entries/5"), ("worm_extra", "zz"), ("delete_marker", "entries/0")}


def test_queue_never_drops_and_waits_for_every_sink(spark):
    rows = [("put", 1, None), ("put", 2, None), ("put", 3, None), ("ack", 1, "a"), ("put", 3, None), ("ack", 1, "b"), ("ack", 1, "b"), ("put", 3, None), ("ack", 9, "a")]
    df = spark.createDataFrame([("q", i, *r) for i, r in enumerate(rows)], "queue string, n long, kind string, item int, sink string")
    got = [(r.depth, r.refused) for r in audit.queue_admission(df, 2, ("a", "b")).orderBy("n").collect()]
    assert got == [(1, False), (2, False), (2, True), (2, False), (2, True), (1, False), (1, False), (2, False), (2, False)]


def test_prefix_roots_of_every_length(spark, monkeypatch):
    lines = [f"l{i}" for i in range(37)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "seg string, line_no int, raw_line string")
    wanted = spark.createDataFrame([("s", n) for n in range(1, 40)], "seg string, entries int")
    for levels in (2, 7):
        monkeypatch.setattr(audit, "LEVELS", levels)
        got = {r.entries: r.root for r in audit.prefix_roots(audit.tree_nodes(df), wanted).collect()}
        assert {n: got[n] for n in range(1, 38)} == {n: tree(lines[:n]) for n in range(1, 38)}
    assert df.groupBy("seg").agg(audit.merkle_root("line_no", "raw_line").alias("r")).first().r == tree(lines)
    assert audit.MerkleRoot.of([]) == audit.EMPTY_ROOT


def checkpoints(lines, *entries):
    rows, prev = [], audit.GENESIS
    for n, e in enumerate(entries, 1):
        head = "sha256:" + hashlib.sha256(lines[e - 1].encode()).hexdigest()
        rows.append(["s", n, e, head, tree(lines[:e]), prev, f"h{n}", True])
        prev = f"h{n}"
    return rows


def test_checkpoints_see_a_rewritten_prefix_and_a_missing_copy(spark):
    schema = "seg string, seq int, entries long, head string, merkle_root string, prev_checkpoint string, body_hash string, signature_ok boolean"
    lines = chain(9)

    def found(rows, lines, held=("h1", "h2", "h3")):
        log = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "seg string, line_no long, raw_line string")
        mirror = spark.createDataFrame([("s", h) for h in held], "seg string, body_hash string")
        cps = spark.createDataFrame([tuple(r) for r in rows], schema)
        return {(r.kind, r.line) for r in audit.verify_checkpoints(cps, log, mirror).collect()}

    good = checkpoints(lines, 3, 6, 9)
    assert found(good, lines) == set() == found([*good, good[1]], lines)
    # A line before every head is rewritten: the heads stay, the roots do not.
    assert found(good, ["x", *lines[1:]]) == {("modified", 1), ("modified", 2), ("modified", 3)}
    assert found(good, lines[:7]) == {("truncation", 3)}
    assert found(good, lines, ("h1", "h3")) == {("worm_missing", 2)}
    forged = [r[:] for r in good]
    forged[1][7] = False
    assert found(forged, lines) == {("forged_checkpoint", 2), ("gap", 3)}
    twice = [r[:] for r in good]
    twice[2][1] = 2
    assert ("reorder", 2) in found(twice, lines)


def test_puts_pin_each_outcome(spark):
    held = spark.createDataFrame([("k1", "a"), ("k2", "b")], "key string, body string")
    rows = spark.createDataFrame([("k1", "a"), ("k2", "x"), ("k3", "c"), ("k3", "d"), ("k3", "c")], "key string, body string")
    got = sorted((r.key, r.body, r.outcome, r.write) for r in audit.put_objects(held, rows).collect())
    assert got == [("k1", "a", "same", False), ("k2", "x", "conflict", False), ("k3", "c", "created", True), ("k3", "c", "same", False), ("k3", "d", "conflict", False)]


def test_report_and_hygiene(spark):
    good = {"event": "request.accepted", "trace_id": "a" * 32, "policy": {"version": "1", "digest": "d"}}
    lines = [good, good | {"trace_id": "x"}, {"event": "boot"}, good | {"event": "egress.cloud"}, good | {"event": "egress.cloud", "rule_ids": ["r"], "provider": "p", "payload_sha256": "h"}]
    log = spark.createDataFrame([("s", i, json.dumps(x)) for i, x in enumerate(lines)], "seg string, line_no long, raw_line string")
    assert tuple(audit.hygiene(log).first()) == (5, 1, 1, 1)
    rows, verdict = audit.report([audit.classify_chain(log), audit.classify_chain(log)], log)
    v = verdict.first()
    assert v.entries == 5 and v.findings == rows.count() > 0 and not v.ok
    assert v.head == "sha256:" + hashlib.sha256(json.dumps(lines[-1]).encode()).hexdigest()
    only = audit.enabled_events(spark.createDataFrame([("a",), ("b",)], "event string"), ["b"]).collect()
    assert [r.event for r in only] == ["b"]
    fields = spark.range(1).select(audit.allowed_fields(F.create_map(F.lit("tool"), F.lit("t"), F.lit("secret"), F.lit("s")), ["tool"]).alias("f")).first().f
    assert fields == {"tool": "t"}
    assert audit.syslog_frame is not None
    frame = spark.range(1).select(audit.syslog_frame(F.lit("ü"), F.lit(0), "h").alias("f")).first().f
    assert frame == f"{len('<110>1 1970-01-01T00:00:00Z h audit - - - ü'.encode())} <110>1 1970-01-01T00:00:00Z h audit - - - ü"


def test_quorum(spark):
    t = lambda n: F.timestamp_seconds(F.lit(n))
    keys = spark.createDataFrame(
        [("a", "fa", ["policy"], 0, 100, False), ("b", "fb", ["policy"], 0, 10, False), ("c", "fc", ["audit"], 0, 100, False), ("d", "fd", ["policy"], 0, 100, True), ("e", "fe", ["policy"], 0, 100, False)],
        "id string, fingerprint string, roles array<string>, nb long, na long, revoked boolean",
    ).withColumns({"not_before": F.timestamp_seconds("nb"), "not_after": F.timestamp_seconds("na")})
    sign = spark.createDataFrame(
        [("s", "a", "fa", True), ("s", "b", "fb", True), ("s", "c", "fc", True), ("s", "d", "fd", True), ("s", "e", "fa", True), ("s", "x", "fx", True), ("s", "e", "fe", False)],
        "subject string, identity string, fingerprint string, crypto_ok boolean",
    )
    states = trust.signature_states(sign, keys, "policy", t(50))
    assert sorted(r.state for r in states.collect()) == ["bad_signature", "expired", "identity_mismatch", "revoked", "role", "unknown", "valid"]
    assert [(r.valid, r.need, r.ok) for r in trust.quorums(states, 1, 0).collect()] == [(1, 1, True)]
    assert not trust.quorums(states, 1, 2).first().ok


def test_evaluation(spark):
    texts = spark.createDataFrame([(1, "ab cd ef")], "id int, text string")
    gold = spark.createDataFrame([(1, 0, 5, "P"), (1, 6, 8, "P")], "id int, s int, e int, type string")
    pred = spark.createDataFrame([(1, 0, 2, "P"), (1, 3, 5, "Q"), (1, 6, 7, "P")], "id int, s int, e int, type string")
    got = {(r.s): (r.strict, r.masked, r.partial) for r in evaluate.span_outcomes(gold, pred, texts).collect()}
    assert got == {0: (False, True, False), 6: (False, False, True)}
    m = evaluate.type_metrics(gold, pred, texts, ["P"]).where("type = 'P'").first()
    assert (m.gold, m.masked, m.pred, m.pred_ok, m.recall_masked, m.precision) == (2, 1, 2, 2, 0.5, 1.0)


@pytest.mark.parametrize("bad, expected", [(None, [True, True, True]), (("K2", "SHOULD", "failed"), [True, True, True]), (("K2", "MUST", "skipped"), [True, False, False])])
def test_levels_are_cumulative(spark, bad, expected):
    data = [(k, "MUST", "passed") for k in ("K1", "K2", "K3")] + ([bad] if bad else [])
    df = spark.createDataFrame(data, "level string, requirement string, outcome string")
    assert [r.reached for r in evaluate.levels(df, ["K1", "K2", "K3"]).orderBy("level").collect()] == expected
