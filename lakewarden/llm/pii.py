r"""Operator 1: personal data by boosted trees over proposed spans.

Four exact rules (e-mail, IP address, payment card, phone with country code) give base
spans, which always stay. Beside them, loose generators propose further, overlapping
spans: secrets, access keys, long hexadecimal strings, phone numbers without a country
code, national ids, account numbers and spelt-out e-mail addresses. Boosted trees score
every proposal by its format (lengths, character mix, checksum) and by its context (a
cue word before it), and a threshold for each kind, calibrated on held-out synthetic
proposals for the wanted precision, selects the spans to redact.

The trees are trained here on synthetic proposals (seeded) and compiled to SQL
expressions: the whole path is DataFrame functions. Spans are code points, end
exclusive; a pattern's spans come from the lengths of what lies between its matches.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.functions.expressions import let
from lakewarden.functions.spans import scan
from lakewarden.llm.boosting import Boosted, boost

BASE = ("email", "ip", "card", "phone")

# The base rules. Possessive repeats match what the plain ones do (nothing follows that
# could take characters back) and cannot exhaust the stack on long texts. An e-mail match
# starts where its run of local characters does, or right after the last match.
_LOCAL = "A-Za-z0-9._%+-"
BASE_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# The generators: kind, pattern (also valid for Python's re), what a text must contain. A secret
# has no greatest length: a cut match would leave its tail unredacted.
_CUES = "password|passwd|passphrase|pwd|token|secret|api[_-]?key|apikey|auth"
GENERATORS = (
    ("secret", rf"(?i:{_CUES})\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.$!#-]{{6,}}+", "="),
    ("secret", rf"(?i:{_CUES})\x20?:\x20?[\"']?[A-Za-z0-9+/_.$!#-]{{6,}}+", ":"),
    ("secret", r"(?<![A-Za-z0-9])[A-Z]{4}[A-Z0-9]{16}(?![A-Za-z0-9])", ""),
    ("secret", r"(?<![A-Za-z0-9])(?:sk|gh[pousr])[-_][A-Za-z0-9_-]{16,}+", ""),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])", "0"),
    ("phone", r"(?<![A-Za-z0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z.-])", "0"),
    ("id", r"(?<![A-Za-z0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "0"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "0"),
    ("email", r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9.-]{1,64}\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z]{2,12}", "at"),
)
EXTRA_ORDER = ("account", "id", "secret")
CONTEXT = 24
CONTEXT_CUE = "(?:call|phone|tel|mobile|fax|contact|reach|ssn|social|iban|account|konto|mail|key|token|secret|password)"
FEATURES = ("length", "digits", "upper", "lower", "marks", "groups", "cue", "checksum", "generator")
PRECISION = 0.97


# ------------------------------------------------------------------ training


def _iban_ok(value: str) -> bool:
    plain = value.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def measure(value: str, before: str, generator: int) -> list[float]:
    """The features of one proposal; the SQL form is ``_feature_columns``."""
    count = lambda pattern: float(len(re.findall(pattern, value)))
    return [
        float(len(value)),
        count("[0-9]"),
        count("[A-Z]"),
        count("[a-z]"),
        count("[^0-9A-Za-z]"),
        count("[0-9]+"),
        float(bool(re.search(CONTEXT_CUE, before.lower()))),
        float(GENERATORS[generator][0] == "account" and _iban_ok(value)),
        float(generator),
    ]


def synthetic_proposals(seed: int = 41, each: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Proposals of every generator, made as true and as look-alike values: features and labels."""
    rng = random.Random(seed)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits, hexa, upper = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lower = upper.lower()

    def iban() -> str:
        body = pick(digits, rng.choice([11, 12, 14, 16, 18, 20]))
        land = rng.choice(["DE", "FR", "ES", "GB", "NL"])
        rest = int("".join(str(int(c, 36)) for c in body + land + "00")) % 97
        text = land + f"{98 - rest:02d}" + body
        return " ".join(text[i : i + 4] for i in range(0, len(text), 4)) if rng.random() < 0.5 else text

    more = random.Random(seed + 1)
    long = lambda letters, n: "".join(more.choice(letters) for _ in range(n))

    def jwt() -> str:
        return ".".join(long(lower + digits + upper + "-_", n) for n in (36, more.randint(40, 300), 43))

    rows, labels = [], []

    def add(generator: int, value: str, before: str, label: int) -> None:
        if re.fullmatch(GENERATORS[generator][1], value):
            rows.append(measure(value, before, generator))
            labels.append(label)

    cues = ["call ", "phone: ", "tel ", "contact us at ", "my ssn is ", "iban ", "account no ", "key "]
    plain = ["and then the ", "version ", "on page ", "order no ", "in the year ", "chapter "]
    for _ in range(each):
        cue, none = rng.choice(cues), rng.choice(plain)
        for g, mark in ((0, "="), (1, ":")):
            name = rng.choice(["password", "token", "secret", "api_key", "pwd"])
            gap = rng.choice(["", " "])
            value = rng.choice([pick(hexa, 18), pick(hexa, 40), pick(lower + digits + upper, 12), pick(lower, 7) + pick(digits, 2)])
            quote = rng.choice(["", '"'])
            add(g, f"{name}{gap}{mark}{gap}{quote}{value}", none, 1)
            add(g, f"{name}{gap}{mark}{gap}{pick(lower, rng.randint(6, 9))}", none, 0)
        add(2, "AKIA" + pick(upper + digits, 16), rng.choice([cue, none]), 1)
        add(2, pick(upper, 20), none, 0)
        add(3, rng.choice(["sk-", "ghp_"]) + pick(lower + digits + upper, 30), rng.choice([cue, none]), 1)
        add(3, "sk-" + "-".join(pick(lower, 5) for _ in range(4)), none, 0)
        add(4, pick(hexa, rng.choice([32, 40, 64])), cue, 1)
        add(4, pick(digits, rng.choice([32, 40])), none, 0)
        local = f"{pick('23456789', 1)}{pick(digits, 2)}{rng.choice('-. ')}{pick('23456789', 1)}{pick(digits, 2)}-{pick(digits, 4)}"
        add(5, local, rng.choice(cues[:4]), 1)
        add(5, f"({pick('23456789', 1)}{pick(digits, 2)}) {pick(digits, 3)}-{pick(digits, 4)}", rng.choice([cue, none]), 1)
        add(5, f"{rng.choice(['19', '20'])}{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", none, 0)
        add(5, f"{pick(digits, 2)} {pick(digits, 3)} {pick(digits, 3)}", none, 0)
        add(6, f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", rng.choice([cue, "my ssn is "]), 1)
        add(6, f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", none, 1)
        add(7, iban(), rng.choice([cue, none]), 1)
        add(7, pick(upper, 2) + pick(digits, 2) + pick(upper + digits, rng.choice([12, 16, 20])), none, 0)
        name = f"{pick(lower, 6)}{rng.choice(['(at)', ' [at] ', ' (at) '])}{pick(lower, 5)}{rng.choice(['(dot)', ' [dot] ', '.'])}com"
        add(8, name, rng.choice([cue, none]), 1)
    # Long and upper-case secrets come last and from a generator of their own: the values above stay as they are.
    for _ in range(each):
        for g, mark in ((0, "="), (1, ":")):
            name = more.choice(["PASSWORD", "Token", "SECRET", "API_KEY", "Password", "token", "secret"])
            value = more.choice([long(hexa, 128), long(lower + digits + upper, more.randint(60, 400)), long(lower + digits, 12), jwt()])
            add(g, f"{name}{mark}{more.choice(['', ' '])}{value}", more.choice(plain), 1)
            add(g, f"{name}{mark} {long(lower, more.randint(6, 9))}", more.choice(plain), 0)
        add(3, more.choice(["sk-", "ghp_"]) + long(lower + digits + upper, more.randint(60, 200)), more.choice([*cues, *plain]), 1)
        add(4, more.choice([long(hexa, 96), long(hexa, 128), long(hexa.upper(), 40), long(hexa.upper(), 64), long(hexa.upper(), 128)]), more.choice([*cues, *plain]), 1)
        add(4, long(digits, more.choice([64, 128])), more.choice(plain), 0)
        add(8, f"{pick(lower, 3)} (at) {pick(digits, 2)}.{pick(lower, 3)}", none, 0)
    return np.array(rows), np.array(labels, float)


@lru_cache(maxsize=1)
def trained() -> tuple[Boosted, dict[str, float]]:
    """The trees and, for each kind, the least margin that keeps the wanted precision on held-out proposals."""
    x, y = synthetic_proposals()
    hold = np.random.default_rng(7).random(len(y)) < 0.25
    model = boost(x[~hold], y[~hold])
    margin, thresholds = model.margin(x[hold]), {}
    kinds = np.array([GENERATORS[int(g)][0] for g in x[hold][:, -1]])
    for kind in dict.fromkeys(k for k, _, _ in GENERATORS):
        own, truth = margin[kinds == kind], y[hold][kinds == kind]
        order = np.argsort(-own)
        precise = np.cumsum(truth[order]) / np.arange(1, len(order) + 1) >= PRECISION
        last = np.flatnonzero(precise)
        thresholds[kind] = float(own[order[last[-1]]]) - 1e-9 if len(last) else float("inf")
    return model, thresholds


# ------------------------------------------------------------------ SQL forms


def _chars(value: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(value, f"[^{keep}]", "")).cast("double")


def _iban_column(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def step(total: Column, c: Column) -> Column:
        code = F.ascii(c)
        digit = code < 58
        return F.when(digit, (total * 10 + code - 48) % 97).otherwise((total * 100 + code - 55) % 97)

    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)
    return (F.length(plain).between(15, 34)) & (rest == 1)


def _feature_columns(value: Column, before: Column, generator: Column, kind: Column) -> list[Column]:
    account = F.when(kind == "account", _iban_column(value)).otherwise(False)
    return [
        F.length(value).cast("double"),
        _chars(value, "0-9"),
        _chars(value, "A-Z"),
        _chars(value, "a-z"),
        F.length(F.regexp_replace(value, "[0-9A-Za-z]", "")).cast("double"),
        F.regexp_count(value, F.lit("[0-9]+")).cast("double"),
        F.lower(before).rlike(CONTEXT_CUE).cast("double"),
        account.cast("double"),
        generator.cast("double"),
    ]


_FOUND = "struct<s:int,e:int,v:string,before:string>"
_EMPTY = f"array<{_FOUND}>"


def spans_of(text: Column, pattern: str, needed: Column) -> Column:
    """``array<struct<s, e, v, before>>`` of a pattern's matches where ``needed`` holds, else empty.

    ``before`` is what stands in the ``CONTEXT`` characters before a match. It is carried along with
    the offset, as looking it up in the text would walk the text from its start for every match.
    """

    def place(state: Column, pair: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        before = F.right(F.concat(state["tail"], pair["b"]), F.lit(CONTEXT))
        tail = F.right(F.concat(before, pair["m"]), F.lit(CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail")), F.struct(start.alias("s"), end.alias("e"), pair["m"].alias("v"), before.alias("before"))

    def walk(matches: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
        pairs = F.zip_with(between, matches, lambda b, m: F.struct(b.alias("b"), m.alias("m")))
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        return let(pairs, lambda rows: scan(rows, start, place, _FOUND))

    found = let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda m: F.when(F.size(m) > 0, walk(m)).otherwise(F.array().cast(_EMPTY)),
    )
    return F.when(needed, found).otherwise(F.array().cast(_EMPTY))


def _valid(kind: str, span: Column) -> Column:
    value = span["v"]
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(
            F.split(value, r"\."),
            lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= F.lit("255"))),
        )
    if kind == "card":
        plain = F.regexp_replace(value, "[^0-9]", "")
        return F.length(plain).between(13, 19) & F.call_function("luhn_check", plain)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<rank:int,kind:string,s:int,e:int>>"


def _validity(kind: str):
    return lambda span: _valid(kind, span)


def _proposed(generator: int):
    """A generator's match with its kind and the text before it."""
    kind = GENERATORS[generator][0]
    rank = BASE.index(kind) if kind in BASE else len(BASE) + EXTRA_ORDER.index(kind)

    def proposal(x: Column) -> Column:
        named = [F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), F.lit(generator).alias("g")]
        return F.struct(*named, x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), x["before"].alias("before"))

    return proposal


def _scorer(model: Boosted):
    def scored(x: Column) -> Column:
        features = F.array(*_feature_columns(x["v"], x["before"], x["g"], x["kind"]))
        margin = let(features, lambda f: model.column([f[i] for i in range(len(FEATURES))]))
        return F.struct(*[x[c].alias(c) for c in ("rank", "kind", "s", "e")], margin.alias("m"))

    return scored


def _selected(thresholds: dict[str, float]):
    """Keep what reaches its kind's threshold."""

    def selected(x: Column) -> Column:
        limit = F.lit(float("inf"))
        for kind, value in thresholds.items():
            limit = F.when(x["kind"] == kind, F.lit(value)).otherwise(limit)
        return x["m"] >= limit

    return selected


def _named(rank: int, kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


_PROPOSAL = "struct<rank:int,kind:string,g:int,s:int,e:int,v:string,before:string>"
_SCORED = "struct<rank:int,kind:string,s:int,e:int,m:double>"


def apart_from(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``: both are marked at their ends, and one ordered pass tells who is inside whom.

    A proposal overlaps a base span if one is open where it begins or begins before it ends: the
    latest end of base spans begun before, and the next begin after, decide.
    """

    def joined(mixed: Column) -> Column:
        reach = scan(mixed, F.lit(-1), lambda most, x: (F.when(x["b"], F.greatest(most, x["e"])).otherwise(most), most), "int")
        back = F.reverse(mixed)
        ahead = F.reverse(let(back, lambda r: scan(r, F.lit(2**31 - 1), lambda least, x: (F.when(x["b"], x["s"]).otherwise(least), least), "int")))

        def kept(pair: Column) -> Column:
            x = pair["x"]
            return ~x["b"] & (pair["reach"] <= x["s"]) & (pair["ahead"] >= x["e"])

        rows = F.filter(F.arrays_zip(mixed.alias("x"), reach.alias("reach"), ahead.alias("ahead")), kept)
        return F.transform(rows, lambda p: p["x"]["own"])

    def mark(x: Column, is_base: bool) -> Column:
        # At equal begins the base span comes first, so it is seen from behind.
        own = F.lit(None).cast(_PROPOSAL) if is_base else x
        return F.struct(x["s"].alias("s"), F.lit(0 if is_base else 1).alias("o"), x["e"].alias("e"), F.lit(is_base).alias("b"), own.alias("own"))

    mixed = F.array_sort(F.concat(F.transform(base, lambda x: mark(x, True)), F.transform(spans, lambda x: mark(x, False))))
    return F.when(F.size(base) > 0, let(mixed, joined)).otherwise(spans)


def best(free: Column) -> Column:
    """Of scored spans those that no overlapping one beats: a higher margin, then the earlier, longer, lower in rank.

    By begin, a span's rivals are neighbours as far as the longest one reaches; spans that
    touch no other are passed by the comparison.
    """

    def key(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), x["rank"].alias("r"), x.alias("x"))

    def better(y: Column, x: Column) -> Column:
        sooner = (y["s"] < x["s"]) | ((y["s"] == x["s"]) & ((y["e"] > x["e"]) | ((y["e"] == x["e"]) & (y["rank"] < x["rank"]))))
        return (y["m"] > x["m"]) | ((y["m"] == x["m"]) & sooner)

    def island(state: Column, x: Column) -> tuple[Column, Column]:
        new = x["s"] >= state["reach"]
        number = state["k"] + F.when(new, 1).otherwise(0)
        return F.struct(F.greatest(state["reach"], x["e"]).alias("reach"), number.alias("k")), F.struct(number.alias("k"), x.alias("x"))

    def split(spans: Column) -> Column:
        start = F.struct(F.lit(-1).alias("reach"), F.lit(0).alias("k"))
        return let(scan(spans, start, island, f"struct<k:int,x:{_SCORED}>"), per_island)

    def per_island(rows: Column) -> Column:
        # Rows of one island stand together: the first of the rows with its number is found by its place.
        first = F.transform(rows, lambda r, i: F.when((i == 0) | (F.get(rows, i - 1)["k"] != r["k"]), i))
        starts = F.filter(first, lambda i: i.isNotNull())

        def winners(starts_: Column) -> Column:
            def one(at: Column, n: Column) -> Column:
                end = F.coalesce(F.get(starts_, n + 1), F.size(rows))
                own = F.transform(F.slice(rows, at + 1, end - at), lambda r: r["x"])
                return let(own, lambda o: F.when(F.size(o) == 1, o).otherwise(F.filter(o, lambda x: ~F.exists(o, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]) & better(y, x)))))

            return F.flatten(F.transform(starts_, one))

        return let(starts, winners)

    ordered = F.transform(F.array_sort(F.transform(free, key)), lambda k: k["x"])
    return let(ordered, split)


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, base, extra``: sorted spans ``(rank, kind, s, e)`` of rules and of selected proposals.

    Null is the empty text and has no spans. A proposal that overlaps a base span, or
    one with a higher margin (ties: the earlier), is not kept. Other columns are not
    read; every row gives one row.
    """
    model, thresholds = trained()
    text, digit = F.col("__t"), F.col("__digit")
    named = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("__t"))
    named = named.withColumn("__digit", text.rlike("[0-9]"))
    has = lambda s: F.contains(text, F.lit(s))
    needed = {"email": has("@"), "ip": digit & has("."), "card": digit, "phone": digit & has("+")}
    rules = [
        _named(i, kind, F.filter(spans_of(text, BASE_PATTERNS[kind], needed[kind]), _validity(kind))) for i, kind in enumerate(BASE)
    ]
    proposals = []
    for g, (_, pattern, mark) in enumerate(GENERATORS):
        gate = {"": text.rlike(pattern), "0": digit, "at": has("(at") | has("[at")}.get(mark)
        proposals.append(F.transform(spans_of(text, pattern, has(mark) if gate is None else gate), _proposed(g)))

    def plain(spans):
        keep = F.transform(spans, lambda x: F.struct(*[x[c].alias(c) for c in ("rank", "kind", "s", "e")]))
        return F.array_distinct(keep)

    def chosen(base):
        more = let(F.concat(*proposals), lambda all_: F.when(F.size(all_) > 0, picked(base, all_)).otherwise(F.array().cast(_SPAN)))
        return F.struct(base.alias("base"), more.alias("extra"))

    def picked(base, all_):
        apart = apart_from(all_, base)
        more = F.filter(F.transform(apart, _scorer(model)), _selected(thresholds))
        return let(more, lambda free: F.when(F.size(free) > 1, plain(best(free))).otherwise(plain(free)))

    return named.select("doc_id", let(F.concat(*rules), chosen).alias("found")).select("doc_id", "found.base", "found.extra")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by kind and start, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Counts of base spans by kind, their digest, all spans, and how many there are in all and beyond the base ones.

    A null or empty text has no spans: counts of 0, an empty list and the digest of the empty string.
    """
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by_start = lambda c: F.transform(c, lambda x: F.struct(*[x[k].alias(k) for k in ("rank", "s", "e", "kind")]))
    count = lambda i: F.size(F.filter("base", lambda x: x["rank"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(BASE)],
        F.sha2(spans_text(by_start(F.col("base"))), 256).alias("base_sha256"),
        spans_text(by_start(F.concat("base", "extra"))).alias("spans"),
        (F.size("base") + F.size("extra")).cast("long").alias("n_spans"),
        F.size("extra").cast("long").alias("n_extra"),
    )
