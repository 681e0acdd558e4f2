"""Spans, checksums, overlaps, masking and its reversal."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lakewarden.functions import expressions as X
from lakewarden.functions.spans import longest_valid, match_spans, resolve, rewrite
from lakewarden.operators import decide, detect
from lakewarden.operators.policy import PolicyError, check_policy, load_policy
from lakewarden.plans import registry
from lakewarden.plans import tables as T
from lakewarden.plans.oracles import ORACLES


def one(spark, column, **values):
    names, row = zip(*values.items(), strict=True)
    return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x


PATTERNS = [
    T.EMAIL,
    r"\b(?:Dr|Prof)\.\s+(?P<pii>[A-ZÄÖÜ][^\W\d_]+(?:\s+[A-ZÄÖÜ][^\W\d_]+)?)",
    r"(?i)\bmein\s+name\s+ist\s+(?P<pii>[^\W\d_]+)",
    r"[0-9]{3}",
]
PIECES = ["a@b.de", "Dr. Weiß", "Prof. Ada Öz", "mein Name ist Jörg", "😀", " ", "\n", "123", "1234567", "é", "x.y@z.org", "<", "Mein  name ist K"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_spans_agree_with_python(spark, pattern):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " "]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [(x.s, x.e) for x in r.spans] for r in rows.select("id", match_spans(F.col("text"), rewrite(pattern)).alias("spans")).collect()}
    compiled = re.compile(pattern)
    group = "pii" if "pii" in compiled.groupindex else 0
    for i, text in enumerate(texts):
        assert got[i] == [m.span(group) for m in compiled.finditer(text or "")]


def test_patterns_that_match_nothing_or_nest_are_refused():
    with pytest.raises(ValueError):
        rewrite("a*")
    with pytest.raises(ValueError):
        rewrite("x(y(?P<pii>z))")


@pytest.mark.parametrize("value, ok", [("DE89 3704 0044 0532 0130 00", True), ("DE89370400440532013001", False), ("GB29NWBK60161331926819", True), ("DE8", False)])
def test_iban(spark, value, ok):
    assert one(spark, X.iban_ok(F.col("v")), v=value) is ok


@pytest.mark.parametrize("value, ok", [("4111 1111 1111 1111", True), ("4111111111111112", False), ("79927398713", False)])
def test_luhn_needs_twelve_digits(spark, value, ok):
    assert one(spark, X.luhn_ok(F.col("v")), v=value) is ok


def test_longest_valid_prefix_stops_at_a_token_boundary(spark):
    text = "paid to DE89 3704 0044 0532 0130 00 VIA BANKDEFF, not to DE00 1234 5678 9012 3456 78"
    spans = longest_valid(F.col("text"), match_spans(F.col("text"), rewrite(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")), "iban-mod97")
    assert [x.v for x in one(spark, spans, text=text)] == ["DE89 3704 0044 0532 0130 00"]


def test_cards_agree_with_their_sql(spark, tmp_path):
    card, secret = "4111111111111111", 'token = "%s"'
    texts = [
        card, f"x{card}", f"{card}x", f"{card}é", f"é{card}²", f"{card}٣", f"{card}, {card}.{card}", None, "", "4111111111111112",
        secret % ("a" * 24 + card), secret % ("0" * 24 + card), f'{card}{secret % ("b" * 40)}{card}', f'token = "{"a" * 23}{card}"',
        "1" * 19 + card, card + "0" * 20, card * 3, "0" * 12, "0" * 19, "0" * 20, f"{card}x{card}",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.execute(ORACLES["detect_card_luhn"]).fetchall()
    assert sorted(map(tuple, registry.detect_card_luhn(spark, str(tmp_path)).collect())) == sorted(want)


def greedy(spans):
    chosen = []
    for c in sorted(spans, key=lambda c: (-(c[1] - c[0]), -c[3], c[0], c[4], c[5])):
        if all(c[1] <= o[0] or c[0] >= o[1] for o in chosen):
            chosen.append(c)
    return sorted(chosen, key=lambda c: c[0])


def test_overlaps_longest_then_rank_then_start(spark):
    rng = random.Random(4)
    cases = []
    for i in range(80):
        spans = []
        for k in range(rng.randint(0, 9)):
            s = rng.randint(0, 30)
            spans.append((s, s + rng.randint(1, 9), "v", rng.randint(0, 3), k, 0, "E"))
        cases.append((i, spans))
    rows = spark.createDataFrame(cases, "id int, c array<struct<s:int,e:int,v:string,rank:int,det:int,pat:int,entity:string>>")
    for r, (_, spans) in zip(sorted(rows.select("id", resolve(F.col("c")).alias("r")).collect()), cases, strict=True):
        assert [tuple(x) for x in r.r] == greedy(spans)


TEXTS = [
    ("r1", 0, "mail a@b.de and c@d.org then a@b.de"),
    ("r1", 1, 'x 10.0.0.1 a@b.de token = "' + "ab" * 20 + '"'),
    ("r2", 0, "<EMAIL_1> stays, 😀 z@y.com"),
    ("r2", 1, ""),
    ("r2", 2, None),
]


def masked(spark):
    rows = spark.createDataFrame(TEXTS, "request_id string, msg_idx int, text string")
    found = detect.detect(rows, T.policy())
    table = detect.vault(found, T.policy())
    return detect.mask(found, ["request_id", "msg_idx"], table), table


def test_numbering_runs_over_a_request_and_repeats_share_a_placeholder(spark):
    out, table = masked(spark)
    got = {(r.request_id, r.msg_idx): r.masked for r in out.collect()}
    assert got[("r1", 0)] == "mail <EMAIL_1> and <EMAIL_2> then <EMAIL_1>"
    assert got[("r1", 1)] == 'x <IP_1> <EMAIL_1> token = "<SECRET_1>"'
    assert got[("r2", 0)] == "<EMAIL_1> stays, 😀 <EMAIL_1>"
    assert got[("r2", 1)] == "" and got[("r2", 2)] is None
    assert {(r.value, r.occurrences) for r in table.where("entity = 'EMAIL' and request_id = 'r1'").collect()} == {("a@b.de", 3), ("c@d.org", 1)}


def test_restoring_needs_a_role_and_never_shows_secrets(spark):
    out, table = masked(spark)
    for roles, email, ip in ((["editor"], "a@b.de", "10.0.0.1"), (["reader"], "a@b.de", "<IP_1>"), ([], "<EMAIL_1>", "<IP_1>")):
        back = {(r.request_id, r.msg_idx): r.restored for r in detect.demask(out, table, decide.strings(roles), ["request_id", "msg_idx"]).collect()}
        assert back[("r1", 1)] == f'x {ip} {email} token = "<SECRET_1>"'
        assert len(back) == len(TEXTS) and back[("r2", 2)] is None
    assert {(r.msg_idx, r.entity, r.n) for r in detect.mask_counts(out.where("request_id = 'r1'"), ["msg_idx"]).collect()} == {(0, "EMAIL", 3), (1, "EMAIL", 1), (1, "IP", 1), (1, "SECRET", 1)}


def test_detection_stands_once_in_a_plan(spark):
    """Patterns in the optimized plan: each detector's, once for the matches and once for what lies between."""
    rows = spark.createDataFrame(TEXTS, "request_id string, msg_idx int, text string")
    counted = decide.entity_counts_by(detect.detect(rows, T.policy()), "request_id")
    decided = decide.decide(
        detect.detect(rows, T.policy()).select("request_id", detect.entity_set(F.col("spans")).alias("entities"), decide.strings(["reader"]).alias("roles"), F.lit("crawler").alias("agent"), F.lit("m1").alias("model")),
        T.policy(),
    )
    for plan in (counted, decided):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("regexp_extract_all(") <= 6, text.count("regexp_extract_all(")


def test_spans_by_sql(spark):
    rows = spark.createDataFrame(TEXTS, "request_id string, msg_idx int, text string")
    detect.detect(rows, T.policy()).createOrReplaceTempView("found")
    detect.register(spark)
    got = spark.sql("select msg_idx, x.s, x.entity from found, lateral explode_spans(spans) x where request_id = 'r1'").collect()
    assert {(r.msg_idx, r.s, r.entity) for r in got} == {(0, 5, "EMAIL"), (0, 16, "EMAIL"), (0, 29, "EMAIL"), (1, 2, "IP"), (1, 11, "EMAIL"), (1, 27, "SECRET")}
    spans = detect.detector_registry(T.policy())["mail"](F.col("text"))
    assert rows.where("msg_idx = 0 and request_id = 'r1'").select(F.size(spans)).first()[0] == 3


def test_masked_text_has_no_vault_value_and_no_hits(spark):
    out, table = masked(spark)
    values = [r.value for r in table.collect()]
    assert not any(v in (r.masked or "") for r in out.collect() for v in values)
    assert detect.egress_hits(out.select("masked"), T.policy(), "masked").agg(F.sum("hits")).first()[0] == 0
    assert detect.leaks(out, table).count() == 0


def test_leaks_are_found_wherever_they_stand(spark, monkeypatch):
    values = ["john@x.com", "a@x.com", "+49 170 1234", "plainname", "x@com", "..ab-cd..", "abc", "a", "王小明", "ö", "", "none such"]
    texts = ["xjohn@x.com", "mailto7john@x.company a@x.com", "no john@y.com", "call+49 170 12345", "myplainnames", "6x@comma", "z..ab-cd..z", None, "", "john@x.com john@x.com", "abc", "我叫王小明。", "schön"]
    table = spark.createDataFrame([(v,) for v in values], "value string")
    expected = {v: n for v in values if v and (n := sum(v in (t or "") for t in texts))}
    for block in (500_000, 3):
        monkeypatch.setattr(detect, "VALUES_AT_ONCE", block)
        got = {r.value: r.n_texts for r in detect.leaks(spark.createDataFrame([(t,) for t in texts], "masked string"), table).collect()}
        assert got == expected
    assert detect.leaks(spark.createDataFrame([], "masked string"), table.limit(0)).count() == 0


def test_redact_and_hash(spark):
    rows = spark.createDataFrame(TEXTS[:1], "request_id string, msg_idx int, text string")
    found = detect.detect(rows, T.policy())
    red, hashed = found.select(*[detect.mask_without_vault(F.col("text"), F.col("spans"), s) for s in ("redact", "hash")]).first()
    assert red == "mail <EMAIL_REDACTED> and <EMAIL_REDACTED> then <EMAIL_REDACTED>"
    assert re.fullmatch(r"mail (<EMAIL_[0-9a-f]{10}>) and <EMAIL_[0-9a-f]{10}> then \1", hashed)


def test_a_policy_is_refused_with_all_its_faults():
    import copy

    raw = copy.deepcopy(T.RAW_POLICY)
    raw["spec"]["routing"]["rules"][0]["priority"] = 60
    raw["spec"]["tools"]["definitions"][0]["allow"]["roles"] = ["nobody"]
    raw["spec"]["routing"]["rules"][1]["route"]["localProviders"] = ["cloud-b"]
    assert len(check_policy(raw)) == 3
    raw["spec"]["piiDetectors"][0]["patterns"] = ["("]
    with pytest.raises(PolicyError, match="duplicate priority.*unknown role nobody.*mail"):
        load_policy(raw)
