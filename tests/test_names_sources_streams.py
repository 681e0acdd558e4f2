"""Tokens, sentences, name lists, files, generated sentences, and streams against their batch forms."""

import json
import os
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewarden.operators import names, tools
from lakewarden.operators.policy import PolicyError
from lakewarden.sources import readers, synthetic, writers
from lakewarden.streaming import stateful


def names_df(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_tokens_and_gaps(spark):
    got = names.tokens(docs(spark, "😀 Jörg-Max, x\tÖz", "", None)).orderBy("i").collect()
    assert [(r.s, r.e, r.word, r.gap) for r in got] == [(2, 10, "Jörg-Max", ", "), (12, 13, "x", "\t"), (14, 16, "Öz", "")]


def test_name_pairs(spark):
    given, surnames = names_df(spark, "anna"), names_df(spark, "weiss", "berg")
    texts = ["Anna Weiß kam", "anna von Berg", "Anna, Berg", "Anna von", "Anna\n Berg", "Anna zu Hause Berg"]
    got = {(r.id, r.s, r.e) for r in names.gazetteer_pairs(docs(spark, *texts), given, surnames).collect()}
    assert got == {(0, 0, 9), (1, 0, 13), (4, 0, 10)}


def test_sentences(spark):
    got = names.sentences(docs(spark, "Hallo Dr. Weiß. Gut!\nNr. 3. Mai z. B. so? Ende")).orderBy("sid").collect()
    assert [r.sentence.strip() for r in got] == ["Hallo Dr. Weiß.", "Gut!", "Nr. 3. Mai z. B. so?", "Ende"]


def test_triggers_and_gated_model(spark):
    common, given = names_df(spark, "heute", "kommt", "der", "zug", "herr", "sie", "fragen", "und"), names_df(spark, "anna")
    d = docs(spark, "Heute kommt der Zug.", "Heute kommt Zwiebel.", "Qwert kommt.", "Fragen Sie herrn qwertz und sie.", "qwa von zxcv kommt")
    hits = names.suspicious_tokens(d, common, given)
    got = {(r.id, r.reason) for r in hits.collect()}
    assert (1, "capitalizedUnknown") in got and (2, "sentenceStartUnknown") in got and not any(i == 0 for i, _ in got)
    assert (3, "nearPersonCue") in got and (4, "unknownLowerBigram") in got
    assert not any(r == "nearPersonCue" for i, r in got if i != 3)

    def load():
        return lambda texts: [[(m.start(), m.end(), "PER", 0.9) for m in re.finditer("Zwiebel|Zug", t)] for t in texts]

    found = names.cascade(d, hits, load, ["PER"], 0.5)
    assert [(r.id, r.s, r.e) for r in found.collect()] == [(1, 12, 19)]
    assert names.model_spans(d, load, ["PER"], 0.95).count() == 0
    primary = spark.createDataFrame([(0, 16, 19, 0.4), (1, 12, 19, 0.9)], "id int, s int, e int, score double")
    low = names.suspicious_sentences(d, common, given, primary=primary).where("reason = 'lowConfidence'")
    assert [(r.id, r.sid) for r in low.collect()] == [(0, 0)]
    off = names.suspicious_sentences(d, common, given, {k: False for k in names.TRIGGERS}, primary=primary)
    assert off.count() == 0


def test_the_gate_shuffles_no_tokens_and_long_lists_give_the_same(spark, monkeypatch):
    common, given = names_df(spark, "der", "zug", "herr", None), names_df(spark, "anna")
    every = dict.fromkeys(names.TRIGGERS, True)
    words = ["Anna", "anna", "Zwiebel", "qwert", "von", "Herr", "der", "Zug.", "x\n\n", "Ab-Cdef", "gez.", "😀", "Dr. Weiß!", "\t"]
    rng = random.Random(8)
    d = docs(spark, *(" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(200)), "", None, " . ")
    short = names.suspicious_tokens(d, common, given, every)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Exchange", "Window", "Generate", "Join")), plan
    expected = sorted(map(tuple, short.collect()))
    assert {r for _, _, r, _, _ in expected} == set(names.REASONS)
    assert len(set(expected)) == len(expected)
    assert sorted(map(tuple, names.suspicious_sentences(d, common, given, every).collect())) == sorted({x[:3] for x in expected})
    monkeypatch.setattr(names, "MOST_NAMES", 1)
    assert sorted(map(tuple, names.suspicious_tokens(d, common, given, every).collect())) == expected


def test_cue_phrases():
    cue = re.compile(names.phrase_pattern(names.CUES))
    for text in ("Sehr geehrte Damen", "gez. X", "i.A. X", "i. V. X", "mit freundlichen Gruessen", "Viele Grüße", "ICH HEISSE Jo", "mein  Name\nist"):
        assert cue.search(text), text
    for text in ("Herrlich", "biegez", "ich binde", "hinweis", "frauen"):
        assert not cue.search(text), text


def test_windows_around_hits_hold_names_whole(spark):
    text = "x " * 600 + "Zwiebel" + " y" * 600
    d = docs(spark, text)
    hits = spark.createDataFrame([(0, 0, "r", 1200, 1207), (0, 0, "r", 1250, 1252)], "id int, sid int, reason string, s int, e int")
    got = sorted((r.s, r.e) for r in names.model_windows(d, hits, 100).collect())
    assert got == [(1153, 1253), (1253, 1301)]

    def load():
        return lambda texts: [[(m.start(), m.end(), "PER", None) for m in re.finditer("Zwiebel", t)] for t in texts]

    assert [(r.s, r.e) for r in names.cascade(d, hits, load, ["PER"], 0.5, 100).collect()] == [(1200, 1207)]


def test_context_rules(spark):
    given, surnames = names_df(spark, "anna"), names_df(spark, "weiss", "berg-klein")
    cand = r"(?P<pii>[^\W\d_]+(?:-[^\W\d_]+)*(?:[ \t]+[^\W\d_]+(?:-[^\W\d_]+)*){0,2})"
    rules = [("cue", [rf"(?i)\bmein name ist\s+{cand}"]), ("gazetteer-all", [rf"(?i)\bhallo\s+{cand}"])]
    texts = ["Mein Name ist Qwer Tzui heute", "mein name ist der Anna und so", "mein name ist IT Qwer", "Hallo Anna Weiß", "hallo Anna Qwer", "mein Name ist Anna IT-Service", "Hallo Berg-Klein", "nichts", None]
    got = {(r.id, r.s, r.e) for r in names.gazetteer_spans(docs(spark, *texts), given, surnames, True, rules).collect()}
    assert got == {(0, 14, 29), (1, 18, 22), (3, 6, 15), (5, 14, 18), (6, 6, 16)}
    with pytest.raises(ValueError):
        names.context_names(docs(spark, "x"), [("maybe", ["(?P<pii>x)"])], given)


def test_people_are_detected_with_all_detectors(spark):
    import copy

    from lakewarden.operators.policy import load_policy
    from lakewarden.plans.tables import RAW_POLICY

    raw = copy.deepcopy(RAW_POLICY)
    masking = {"strategy": "placeholder", "placeholderFormat": "<PERSON_{n}>"}
    raw["spec"]["piiDetectors"] += [
        {"id": "lists", "entity": "PERSON", "type": "gazetteer", "gazetteer": {"given": "g", "surnames": "s"}, "masking": masking},
        {"id": "model", "entity": "PERSON", "type": "ner", "ner": {"labels": ["PER"], "minScore": 0.5}, "masking": masking},
    ]
    policy = load_policy(raw)
    d = docs(spark, "Anna Weiß anna@weiss.de", "Qwert kommt", None)

    def load():
        return lambda texts: [[(m.start(), m.end(), "PER", 0.9) for m in re.finditer("Qwert|Weiß", t)] for t in texts]

    lists = {"g": names_df(spark, "anna"), "s": names_df(spark, "weiss")}
    got = {r.id: [(x.s, x.e, x.entity) for x in r.spans] for r in names.detect_people(d, policy, lists, load).collect()}
    assert got == {0: [(0, 9, "PERSON"), (10, 23, "EMAIL")], 1: [(0, 5, "PERSON")], 2: []}
    for broken in ({}, lists):
        with pytest.raises(ValueError):
            names.detect_people(d, policy, broken, load if broken == {} else None)


def test_name_list_builder(spark):
    built = names.build_name_list([(names_df(spark, " Özil", "Al", "und", "x1", "Anna"), 3), (names_df(spark, "Anna", "Bo"), 2)])
    assert [r.name for r in built.collect()] == ["Anna", "Bo", "Özil"]


def test_windows_merge(spark):
    w = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 20, 31)], "id int, s int, e int")
    assert sorted((r.s, r.e) for r in names.merge_windows(w, 10).collect()) == [(0, 9), (20, 30), (30, 31)]


def test_lists_and_logs(spark, tmp_path):
    (tmp_path / "n.txt").write_text("# c\n Anna \n\nWEIß\nanna\n", encoding="utf-8")
    assert {r.name for r in readers.read_lexicon(spark, str(tmp_path / "n.txt")).collect()} == {"anna", "weiss"}
    (tmp_path / "empty.txt").write_text("#\n")
    with pytest.raises(PolicyError):
        readers.read_name_list(spark, str(tmp_path / "empty.txt"))
    for bad in ("/etc/x", "a/../../b"):
        with pytest.raises(PolicyError):
            readers.safe_relative(bad)
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.jsonl").write_text("one\n\ntwo\n")
    assert [(r.line_no, r.raw_line) for r in readers.read_audit_log(spark, str(tmp_path / "log")).orderBy("line_no").collect()] == [(1, "one"), (2, "two")]


def test_policy_watch_keeps_the_last_valid(spark, tmp_path):
    from lakewarden.plans.tables import RAW_POLICY

    path = tmp_path / "p.json"
    path.write_text(json.dumps(RAW_POLICY))
    watch = readers.PolicyWatch(spark, str(path))
    first = watch.current()
    path.write_text("{")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    (tmp_path / ".p.json.crc").unlink(missing_ok=True)
    assert watch.current() is first and watch.fault is not None


def test_event_stream_lines(spark):
    chunk = {"choices": [{"index": 0, "delta": {"content": "hi"}, "finish_reason": None}]}
    lines = ["data: " + json.dumps(chunk), ": ping", "data: {", "data: [DONE]"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "request_id string, line_no int, line string")
    assert [(r.line_no, r.choice, r.content) for r in readers.sse_chunks(df).collect()] == [(0, 0, "hi")]


def test_mirror_puts_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k1", "a")], "key string, body string")
    path = str(tmp_path / "mirror")
    assert sorted((r.key, r.outcome) for r in writers.put_mirror(rows, path).collect()) == [("k1", "created"), ("k1", "same"), ("k2", "created")]
    again = spark.createDataFrame([("k1", "a"), ("k2", "x"), ("k3", "c")], "key string, body string")
    assert {r.key: r.outcome for r in writers.put_mirror(again, path).collect()} == {"k1": "same", "k2": "conflict", "k3": "created"}
    assert {(r.key, r.body) for r in spark.read.parquet(path).collect()} == {("k1", "a"), ("k2", "b"), ("k3", "c")}


def test_generated_sentences_are_annotated_exactly(spark):
    rows = synthetic.sentences(spark, 20)
    for r in rows.collect():
        assert all(r.text[e.start : e.end] == e.value for e in r.entities)
    assert readers.gold_spans(rows).count() == 20


def stream(spark, tmp_path, schema, batches, build, name, timers=False):
    """Batches as files, one a trigger, in the order of their times."""
    source = tmp_path / f"{name}-in"
    source.mkdir()
    for i, batch in enumerate(batches):
        path = source / f"{i}.json"
        pd.DataFrame(batch, columns=[c.split()[0] for c in schema.split(", ")]).to_json(path, orient="records", lines=True)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        sink = build(rows).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-cp")).outputMode("append")
        if timers:  # a query with timers of its own never ends by itself
            query, until, expected = sink.start(), time.time() + 60, sum(map(len, batches))
            while time.time() < until and query.isActive and sum(p.numInputRows for p in query.recentProgress) < expected:
                time.sleep(0.2)
            query.stop()
        else:
            query = sink.trigger(availableNow=True).start()
            query.awaitTermination(120)
        assert query.exception() is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    return spark.table(name)


def test_restored_stream_equals_restored_whole(spark, tmp_path):
    text = "a < b <EMAIL_1> and <X_9> <EMAIL_"
    vault = json.dumps({"<EMAIL_1>": "m@x.de"})
    for size in (1, 5):
        rows = [("r", 0, i, text[i : i + size], i + size >= len(text), vault) for i in range(0, len(text), size)]
        schema = "request_id string, choice int, chunk_no long, content string, last boolean, vault_json string"
        out = stream(spark, tmp_path, schema, [rows[:4], rows[4:]], stateful.demask_stream, f"demasked{size}", True)
        assert "".join(r.content for r in sorted(out.collect(), key=lambda r: r.chunk_no)) == text.replace("<EMAIL_1>", "m@x.de")


def test_last_chunks(spark):
    rows = [("r", 0, 0, None), ("r", 0, 1, "stop"), ("r", 1, 0, None), ("r", 1, 2, None), ("q", 0, 0, None)]
    chunks = spark.createDataFrame(rows, "request_id string, choice int, chunk_no int, finish_reason string")
    done = spark.createDataFrame([("r",)], "request_id string")
    got = {(r.request_id, r.choice, r.chunk_no) for r in stateful.with_last(chunks, done).where("last").collect()}
    assert got == {("r", 0, 1), ("r", 1, 2)}


def event_stream(spark, tmp_path, columns, batches, build, name):
    """Batches of rows ``(..., micros)`` as a stream with an event time; a far later row closes the watermark."""
    schema = ", ".join([*columns, "micros long"])
    return stream(spark, tmp_path, schema, batches, lambda d: build(d.withColumn("at", F.timestamp_micros("micros")).drop("micros")), name)


BASE = 1_700_000_000_000_000


@pytest.mark.parametrize("turned", [False, True])
def test_rate_limit_stream_equals_batch_in_any_order_of_arrival(spark, tmp_path, turned):
    rng = random.Random(1)
    calls = [("t", f"s{rng.randint(0, 2)}", n, BASE + n * 700_000) for n in range(40)]
    late = [("t", "end", 1000, BASE + 10_000_000_000)]
    halves = [calls[15:], calls[:15]] if turned else [calls[:15], calls[15:]]
    out = event_stream(spark, tmp_path, ["tool string", "subject string", "n long"], [*halves, late], lambda d: stateful.rate_limit_stream(d, 3, 5, "1 hour"), f"limited{turned}")
    df = spark.createDataFrame(calls, "tool string, subject string, call_no long, micros long").withColumn("at", F.timestamp_micros("micros"))
    batch = tools.admit(df, ["tool", "subject"], 3, 5)
    expected = {(r.call_no, r.admitted) for r in batch.collect()}
    assert {(r.n, r.admitted) for r in out.collect() if r.n < 1000} == expected and not all(ok for _, ok in expected)


def test_confirmation_and_queue_streams_equal_their_batches(spark, tmp_path):
    second = 1_000_000
    events = [
        ("a", 1, "create", True, True, True, 0), ("a", 2, "approve", True, True, True, 5 * second), ("a", 3, "approve", True, True, True, 6 * second),
        ("b", 1, "create", True, True, True, 0), ("b", 2, "approve", True, True, False, second), ("c", 1, "create", True, True, True, 0),
        ("c", 2, "reject", True, True, True, 2000 * second), ("d", 1, "approve", True, True, True, 0), ("e", 1, "create", True, True, True, 0), ("e", 2, "approve", False, True, True, second),
    ]
    columns = ["confirmation_id string", "n long", "action string", "allowed boolean", "args_ok boolean", "succeeds boolean"]
    events = [(*e[:-1], BASE + e[-1]) for e in events]
    end = [[("z", 1, "create", True, True, True, BASE + 10**11)]]
    out = event_stream(spark, tmp_path, columns, [events[4:], events[:4], *end], lambda d: stateful.confirmation_stream(d, lateness="1 hour"), "confirmed")
    df = spark.createDataFrame(events, ", ".join([*columns, "micros long"])).withColumn("at", F.timestamp_micros("micros"))
    batch = {(r.confirmation_id, r.n, r.code, r.status) for r in tools.confirmations(df).collect()}
    assert {(r.key, r.n, r.code, r.status) for r in out.collect() if r.key != "z"} == batch
    assert ("b", 2, 200, "failed") in batch and ("c", 2, 409, "expired") in batch and ("e", 2, 403, "denied") in batch

    from lakewarden.operators.audit import queue_admission

    rows = [("q", 0, "put", 1, None), ("q", 1, "put", 2, None), ("q", 2, "put", 3, None), ("q", 3, "ack", 1, "x"), ("q", 4, "ack", 1, "y"), ("q", 5, "put", 3, None)]
    columns = ["queue string", "n long", "kind string", "item long", "sink string"]
    timed = [(*r, BASE + r[1] * second) for r in rows]
    end = [[("z", 90, "put", 1, None, BASE + 10**11)]]
    out = event_stream(spark, tmp_path, columns, [timed[3:], timed[:3], *end], lambda d: stateful.queue_stream(d, 2, ("x", "y"), "1 hour"), "queued")
    batch = queue_admission(spark.createDataFrame(rows, ", ".join(columns)), 2, ("x", "y"))
    assert {(r.n, r.depth, r.refused) for r in out.collect() if r.key == "q"} == {(r.n, r.depth, r.refused) for r in batch.collect()}


def test_contexts_are_found_by_later_batches(spark, tmp_path):
    first, second = [("r", 1, "put", "v"), ("q", 1, "get", None)], [("r", 2, "get", None)]
    out = stream(spark, tmp_path, "request_id string, n long, kind string, value string", [first, second], stateful.context_stream, "contexts", True)
    assert {(r.request_id, r.n, r.value) for r in out.collect()} == {("r", 1, "v"), ("q", 1, None), ("r", 2, "v")}


def test_checkpoints_are_due_by_time_and_number(spark):
    rows = spark.createDataFrame([("s", n) for n in (0, 1, 2, 3, 61)], "seg string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r.entries, r.checkpoints) for r in stateful.checkpoints_due(rows, 3, 60).collect())
    assert got == [(1, 1), (4, 2)]


def test_open_tails():
    for text, cut in (("x <EMA", 2), ("x < y", 5), ("<A" + "B" * 60, 62), ("<EMAIL_1", 0), ("<1", 2), ("a<", 1), ("", 0)):
        assert stateful.open_tail(text) == cut, text
