"""Roles, classes, routes, tools, limits and confirmations."""

import random

from pyspark.sql import functions as F

from lakewarden.functions import expressions as X
from lakewarden.operators import decide, requests, retrieval, tools
from lakewarden.operators.policy import rules_table
from lakewarden.plans import tables as T


def rows(spark):
    data = [
        (1, [], ["reader"], None, "m2"),
        (2, ["EMAIL"], ["editor"], "crawler", "m1"),
        (3, ["SECRET", "EMAIL"], ["editor", "reader"], "crawler", "m1"),
        (4, [], ["editor"], "crawler", "m1"),
        (5, [], [], "crawler", "m2"),
        (6, [], [], None, "m1"),
        (7, ["CARD"], ["editor"], None, "m2"),
    ]
    return spark.createDataFrame(data, "request_id int, entities array<string>, roles array<string>, agent string, model string")


def test_decisions(spark):
    got = {r.request_id: r for r in decide.decide(rows(spark), T.policy()).collect()}
    assert [got[i].data_class for i in range(1, 8)] == ["team", "personal", "credential", "team", "open", "open", "payment"]
    assert [got[i].rule_id for i in range(1, 8)] == ["readers", "private-on-m1", "no-credentials", "crawled", "rest-on-m2", None, "payments-by-editors"]
    assert got[6].status == got[3].status == 403 and got[4].tools == ["lookup", "comment"] and got[2].tools == ["lookup"] and got[1].tools == ["search"]
    assert got[4].web_search and not got[2].web_search and not got[1].web_search


def test_route_as_join_agrees_with_expressions(spark):
    decided = decide.decide(rows(spark), T.policy())
    joined = {r.request_id: r.id for r in decide.route_by_join(decided.drop("rule_id", "mode"), rules_table(spark, T.policy())).collect()}
    assert joined == {r.request_id: r.rule_id for r in decided.collect() if r.rule_id}


def test_trace_stops_at_the_match(spark):
    d = rows(spark).where("request_id = 4")
    t = d.select(decide.route_trace(F.lit("team"), F.col("roles"), F.col("agent"), F.col("model"), T.policy()).alias("t")).first().t
    assert [(x.rule, x.matched, x.reasons) for x in t] == [
        ("no-credentials", False, "data_class"), ("payments-by-editors", False, "data_class"), ("private-on-m1", False, "data_class"), ("crawled", True, ""),
    ]


def test_model_names(spark):
    d = spark.createDataFrame([("",), ("big",), ("nope",)], "m string")
    got = [r.x for r in d.select(decide.resolve_model(F.col("m"), T.policy()).alias("x")).collect()]
    assert [(x.model, x.provider) if x else None for x in got] == [("m1", "local-a"), ("big", "cloud-b"), None]
    assert decide.visible_models(T.policy()) == ["m1", "m2", "big"]


def test_refused_calls_do_not_count(spark):
    rng = random.Random(6)
    calls = [(u, n, rng.randint(0, 100)) for u in range(12) for n in range(30)]
    df = spark.createDataFrame(calls, "u int, call_no long, t long").withColumn("at", F.timestamp_seconds("t"))
    for limit, window in ((1, 7), (2, 10), (5, 30)):
        got = {(r.u, r.call_no): r.admitted for r in tools.admit(df, ["u"], limit, window).collect()}
        for u in range(12):
            held = []
            for t, n in sorted((t, n) for v, n, t in calls if v == u):
                ok = sum(1 for h in held if h > t - window) < limit
                held += [t] if ok else []
                assert got[(u, n)] is ok


def test_confirmations(spark):
    events = [
        ("a", 1, 0, "create", True, True, True), ("a", 2, 5, "approve", True, True, True), ("a", 3, 6, "approve", True, True, True),
        ("b", 1, 0, "create", True, True, True), ("b", 2, 5, "reject", True, True, True),
        ("c", 1, 0, "create", True, True, True), ("c", 2, 1000, "approve", True, True, True),
        ("d", 1, 0, "create", True, True, True), ("d", 2, 5, "approve", False, True, True),
        ("e", 1, 0, "create", True, True, True), ("e", 2, 5, "approve", True, True, False),
        ("f", 1, 0, "approve", True, True, True), ("f", 2, 1, "create", True, True, True), ("f", 3, 2, "create", True, True, True),
    ]
    df = spark.createDataFrame(events, "confirmation_id string, n int, s long, action string, allowed boolean, args_ok boolean, succeeds boolean")
    steps = tools.confirmations(df.withColumn("at", F.timestamp_seconds("s")))
    got = {}
    for r in steps.orderBy("confirmation_id", "n").collect():
        got.setdefault(r.confirmation_id, []).append((r.code, r.status))
    assert got == {
        "a": [(202, "pending"), (200, "executed"), (409, "executed")], "b": [(202, "pending"), (200, "rejected")], "c": [(202, "pending"), (409, "expired")],
        "d": [(202, "pending"), (403, "denied")], "e": [(202, "pending"), (200, "failed")], "f": [(404, "none"), (202, "pending"), (409, "pending")],
    }
    final = {r.confirmation_id: (r.status, r.codes) for r in tools.final_states(steps).collect()}
    assert final["a"] == ("executed", "200:1,202:1,409:1") and final["f"] == ("pending", "202:1,404:1,409:1")


def test_one_key_passes_the_machine_in_constant_memory(spark):
    # Many rows of one key and null keys; the state is handed on across Arrow batches.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(1000).select(F.when(F.col("id") < 900, "k").alias("u"), F.col("id").alias("call_no"), F.timestamp_seconds(F.col("id")).alias("at"))
        got = tools.admit(df, ["u"], 2, 10).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.admitted for r in got if r.u == "k") == 180 and sum(r.admitted for r in got if r.u is None) == 20 and len(got) == 1000


def test_secrets_by_reference(tmp_path, monkeypatch):
    (tmp_path / "s").write_text(" v \n")
    monkeypatch.setenv("A_SECRET", "e")
    refs = {"env:A_SECRET": "e", "env:NONE_SUCH": None, f"file:{tmp_path}/s": "v", f"file:{tmp_path}/none": None, "vault:x": None, None: None}
    assert {r: requests.read_secret(r) for r in refs} == refs


def test_contents_of_parts(spark):
    d = spark.createDataFrame([([("text", "a"), ("text", None)],), ([("text", "a"), ("image", "b")],), ([],)], "p array<struct<type:string,text:string>>")
    assert [(r.x.text, r.x.ok) for r in d.select(requests.plain_content(F.col("p")).alias("x")).collect()] == [("a", True), ("ab", False), ("", True)]


def test_arguments(spark):
    schema = {"properties": {"ticket": {"type": "string", "pattern": "^INC-[0-9]{4}$"}, "note": {"type": "string", "maxLength": 3}}, "required": ["ticket"], "additionalProperties": False}
    cases = {'{"ticket":"INC-1234"}': True, '{"ticket":"INC-12"}': False, '{"note":"a"}': False, '{"ticket":"INC-1234","x":1}': False, '{"ticket":"INC-1234","note":"long"}': False, "{": False, '"s"': False, '{"ticket":7}': False}
    df = spark.createDataFrame([(c,) for c in cases], "a string")
    got = {r.a: r.ok for r in df.select("a", tools.arguments_ok(F.col("a"), schema).alias("ok")).collect()}
    assert got == cases


def test_fragments(spark):
    f = spark.createDataFrame([("r", 2, None, "}", None), ("r", 0, "look", "{", "c1"), ("r", 1, "up", '"a":1', None)], "request_id string, chunk_no int, name string, arguments string, call_id string")
    r = tools.assemble(f, ["request_id"]).first()
    assert (r.call_id, r["name"], r.arguments) == ("c1", "lookup", '{"a":1}')


def test_top_k_respects_groups(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(1, 9)], "vec_id long, embedding array<float>, access_group int")
    q = spark.createDataFrame([(1, [1.0, 0.0], [0])], "query_id int, q array<float>, groups array<int>")
    assert [r.vec_id for r in retrieval.top_k_allowed(q, v, 2).orderBy("rank").collect()] == [8, 6]


def test_small_functions(spark):
    d = spark.createDataFrame([("30s", "2024-01-01T00:00:00Z"), ("2h", "2024-01-01T00:00:00"), ("x", None)], "d string, t string")
    got = d.select(X.duration_seconds(F.col("d")).alias("d"), X.strict_timestamp(F.col("t")).isNotNull().alias("t")).collect()
    assert [(r.d, r.t) for r in got] == [(30, True), (7200, False), (None, False)]
    assert spark.range(1).select(X.ratio(F.lit(1), F.lit(16)).alias("r"), X.ratio(F.lit(1), F.lit(0)).alias("n")).first() == (0.062, None)
