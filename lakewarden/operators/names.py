"""Tokens, sentences, name lists, the cascade gate and pluggable name models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.functions.expressions import casefold_de
from lakewarden.functions.spans import Pattern, match_spans, rewrite
from lakewarden.operators.detect import detect
from lakewarden.operators.policy import Policy
from lakewarden.operators.staged import staged

LETTERS = r"\p{L}\p{Nl}\p{No}"
TOKEN = Pattern(rf"[{LETTERS}]+(?:-[{LETTERS}]+)*")

# Words between a given name and a surname, and words before a full stop that ends no sentence.
PARTICLES = ("von", "van", "de", "da", "del", "di", "zu")
ABBREVIATIONS = (
    "dr", "prof", "hr", "fr", "bzw", "ca", "ggf", "inkl", "exkl", "nr", "str", "tel", "fax",
    "evtl", "usw", "etc", "dipl", "ing", "med", "phil", "rer", "nat", "jur", "univ",
)
# Phrases near which people are named.
CUES = (
    "herr", "herrn", "frau", "hr.", "fr.", "dr.", "prof.",
    "hallo", "hi", "lieber", "liebe", "sehr geehrte", "sehr geehrter", "sehr geehrten",
    "ich bin", "ich heiße", "mein name ist", "mein name lautet",
    "viele grüße", "beste grüße", "herzliche grüße", "liebe grüße", "freundliche grüße", "mit freundlichen grüßen",
    "i. a.", "i. v.", "gez.", "gezeichnet", "unterschrift", "unterzeichnet", "unterzeichnet von", "absender",
    "ansprechpartner", "ansprechpartnerin",
)
# The gate's triggers and their defaults.
TRIGGERS = {
    "capitalizedUnknown": True,
    "sentenceStartUnknown": True,
    "unknownBigram": True,
    "unknownLowerBigram": True,
    "listedGivenName": False,
    "nearPersonCue": True,
    "lowConfidence": True,
}
CUE_WINDOW = 4
LEAST_TOKEN = 3
LOW_CONFIDENCE = 0.5
#: Words that are no part of a name, in the default of the context rules.
STOP_WORDS = (
    "aber", "am", "an", "auf", "aus", "bei", "bis", "bitte", "danke", "das", "dem", "den", "der", "des", "die", "ein", "eine", "einen",
    "einem", "einer", "für", "hallo", "herr", "herrn", "frau", "hat", "im", "in", "ist", "liebe", "lieber", "mein", "meine", "mit", "nach",
    "nicht", "noch", "oder", "sehr", "sind", "über", "um", "und", "unter", "vom", "von", "vor", "war", "wenn", "zu", "zum", "zur",
    "team", "service", "support", "abteilung", "kollegen", "kolleginnen", "zusammen",
)


# The full stop is looked for first: what may not stand before it is costly to test.
_GUARD = rf"(?<![0-9])(?<!(?<![{LETTERS}])[{LETTERS}])(?<!(?i:(?<![{LETTERS}])(?:{'|'.join(ABBREVIATIONS)})))"
SENTENCE = Pattern(rf"(?s:[^\n]+?)(?:(?=\.){_GUARD}\.(?=\s|$)|[!?](?=\s|$)|(?=\n)|$)")


def phrase_pattern(phrases: Iterable[str]) -> str:
    """One pattern for whole phrases in any case: blanks are any white space (or none after a full stop), umlauts and ß may be spelt out."""
    spelt = {"ß": "(?:ß|ss)", "ä": "(?:ä|ae)", "ö": "(?:ö|oe)", "ü": "(?:ü|ue)"}
    parts = []
    for phrase in sorted(phrases, key=len, reverse=True):
        body = "".join(spelt.get(c) or (r"\s+" if c == " " else r"\." if c == "." else c) for c in phrase).replace(r"\.\s+", r"\.\s*")
        parts.append(body + ("" if phrase.endswith(".") else r"\b"))
    return r"(?i)\b(?:" + "|".join(parts) + ")"


def tokens(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, i, s, e, word, gap``: letter runs joined by hyphens; the gap is the text up to the next token
    (or the end)."""
    pieces, found = F.split(text, TOKEN.java, -1), F.regexp_extract_all(text, F.lit(TOKEN.java), F.lit(0))
    rows = docs.select(key, pieces.alias("p"), found.alias("m"))
    n = F.size("m")
    rows = rows.select(key, F.posexplode(F.arrays_zip(F.slice("p", F.lit(1), n).alias("b"), F.col("m").alias("m"), F.slice("p", F.lit(2), n).alias("g"))).alias("i", "t"))
    # Offsets are running sums of lengths: texts have many tokens, and what follows needs this order anyway.
    upto = F.sum(F.length("t.b") + F.length("t.m")).over(W.partitionBy(key).orderBy("i"))
    rows = rows.select(key, "i", upto.cast("int").alias("e"), F.col("t.m").alias("word"), F.col("t.g").alias("gap"))
    return rows.select(key, "i", (F.col("e") - F.length("word")).alias("s"), "e", "word", "gap")


def gazetteer_pairs(docs: DataFrame, given: DataFrame, surnames: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, s, e``: a listed given name, then a listed surname, blanks only between, maybe a particle.

    A particle that a token follows hides the plain test: only the token after it counts.
    Names are casefolded lists ``name``; semi joins keep the duplicates of neither.
    """
    order = W.partitionBy(key).orderBy("i")
    t = tokens(docs, key, text)
    ahead = lambda c, n: F.lead(c, n).over(order)
    t = t.select(
        key, "s", "i", "gap", casefold_de(F.col("word")).alias("name"),
        casefold_de(ahead("word", 1)).alias("n1"), ahead("e", 1).alias("e1"), ahead("gap", 1).alias("gap1"),
        casefold_de(ahead("word", 2)).alias("n2"), ahead("e", 2).alias("e2"),
    )
    blank = lambda c: F.col(c).rlike(r"(?U)^\s+$")
    particle = F.col("n1").isin(*PARTICLES) & F.col("n2").isNotNull()
    t = t.where(blank("gap")).select(
        key, "s", "name",
        F.when(particle, F.when(blank("gap1"), F.col("n2"))).otherwise(F.col("n1")).alias("surname"),
        F.when(particle, F.col("e2")).otherwise(F.col("e1")).alias("e"),
    )
    hits = t.join(given.select("name"), "name", "left_semi")
    return hits.join(surnames.select(F.col("name").alias("surname")), "surname", "left_semi").select(key, "s", "e")


ACCEPTS = ("cue", "gazetteer-all", "gazetteer-any")


def context_names(
    docs: DataFrame, rules: Iterable[tuple[str, Iterable[str]]], listed: DataFrame, stop: Iterable[str] = STOP_WORDS, key: str = "id", text: str = "text"
) -> DataFrame:
    """``key, s, e``: names beside a cue, by rules ``(accept, patterns)`` whose group ``pii`` holds the words that may be one.

    Of those words leading stop words, short capitals and unlisted compounds are skipped,
    the name ends before the next of them, and has three words at most. ``cue`` accepts two or more
    words or a listed one, ``gazetteer-all`` only listed words, ``gazetteer-any`` at least one.
    """
    rules = list(rules)
    if bad := {a for a, _ in rules} - set(ACCEPTS):
        raise ValueError(f"unknown rule: {', '.join(sorted(bad))}")

    def named(accept: str) -> Callable[[Column], Column]:
        return lambda x: F.struct(F.lit(accept).alias("accept"), x["s"].alias("s"), x["v"].alias("v"))

    found = [F.transform(match_spans(F.col(text), rewrite(p)), named(accept)) for accept, patterns in rules for p in patterns]
    if not found:
        return docs.select(key, F.lit(0).alias("s"), F.lit(0).alias("e")).where("false")
    spans = docs.select(key, F.explode_outer(F.concat(*found)).alias("x")).where("x is not null").select(key, "x.*").distinct()
    words = spans.select(key, "accept", F.col("s").alias("at"), F.posexplode(match_spans(F.col("v"), TOKEN)).alias("i", "t"))
    words = words.withColumn("name", casefold_de(F.col("t.v")))
    words = words.join(listed.select("name").distinct().withColumn("listed", F.lit(True)), "name", "left")
    w = F.col("t.v")
    compound = F.contains(w, F.lit("-"))
    short = (F.length(w) <= 4) & (w == F.upper(w)) & (w != F.lower(w)) & ~compound
    blocked = F.col("name").isin(*stop) | short | (compound & F.col("listed").isNull())
    order = W.partitionBy(key, "accept", "at").orderBy("i")
    words = words.withColumn("blocked", blocked)
    # The name is the first run of unblocked words: all blocks up to its words come before its first one.
    words = words.withColumn("blocks", F.sum(F.col("blocked").cast("int")).over(order)).where(~F.col("blocked"))
    words = words.withColumn("first", F.min("blocks").over(order)).where("blocks = first").withColumn("n", F.row_number().over(order)).where("n <= 3")
    names = words.groupBy(key, "accept", "at").agg(
        F.min(F.col("at") + F.col("t.s")).alias("s"), F.max(F.col("at") + F.col("t.e")).alias("e"), F.count(F.lit(1)).alias("n"), F.count("listed").alias("k")
    )
    ok = F.when(F.col("accept") == "cue", (F.col("n") > 1) | (F.col("k") > 0)).when(F.col("accept") == "gazetteer-all", F.col("k") == F.col("n")).otherwise(F.col("k") > 0)
    return names.where(ok).select(key, "s", "e").distinct()


def gazetteer_spans(
    docs: DataFrame, given: DataFrame, surnames: DataFrame, pairs: bool = True, rules: Iterable[tuple[str, Iterable[str]]] = (),
    stop: Iterable[str] = STOP_WORDS, key: str = "id", text: str = "text",
) -> DataFrame:
    """``key, s, e`` of the name-list detector: listed pairs and names by context rules."""
    parts = [context_names(docs, rules, given.select("name").unionByName(surnames.select("name")), stop, key, text)]
    if pairs:
        parts.append(gazetteer_pairs(docs, given, surnames, key, text))
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def attach(rows: DataFrame, spans: DataFrame, column: str, key: str = "id", text: str = "text") -> DataFrame:
    """``rows`` with a detector's spans ``key, s, e`` as ``array<struct<s, e, v, pat>>``, for ``detect(extra=...)``."""
    gathered = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("__spans"))
    value = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.substr(F.col(text), x["s"] + 1, x["e"] - x["s"]).alias("v"), F.lit(0).alias("pat"))
    none = F.array().cast("array<struct<s:int,e:int,v:string,pat:int>>")
    return rows.join(gathered, key, "left").withColumn(column, F.coalesce(F.transform("__spans", value), none)).drop("__spans")


def detect_people(
    rows: DataFrame, policy: Policy, lists: dict[str, DataFrame], load: Callable[[], NerBackend] | None = None, key: str = "id", text: str = "text", context: str = "prompt"
) -> DataFrame:
    """``detect`` with all of a policy's detectors: rules, name lists and models.

    A ``gazetteer`` detector's options name its lists (``given``, ``surnames``: keys of ``lists``),
    whether pairs count, and its context rules; a ``ner`` detector's its labels and least score. A
    detector whose list or model is missing refuses the whole query.
    """
    extra, out = [], rows
    for number, d in enumerate(policy.detectors):
        if context not in d.contexts or d.kind not in ("gazetteer", "ner"):
            continue
        own = d.options.get(d.kind, {})
        if d.kind == "gazetteer":
            missing = [n for n in (own.get("given", "given"), own.get("surnames", "surnames")) if n not in lists]
            if missing:
                raise ValueError(f"detector {d.id}: no list {', '.join(missing)}")
            rules = [(r["accept"], r.get("patterns", ())) for r in own.get("contextRules", ())]
            spans = gazetteer_spans(rows, lists[own.get("given", "given")], lists[own.get("surnames", "surnames")], own.get("matchPairs", True), rules, own.get("stop", STOP_WORDS), key, text)
        else:
            if load is None:
                raise ValueError(f"detector {d.id}: no model")
            named = rows.select(key, F.col(text).alias("text"))
            spans = model_spans(named, load, own.get("labels", ("PER",)), own.get("minScore", 0.0), key).select(key, "s", "e")
        column = f"__detector_{number}"
        out = attach(out, spans, column, key, text)
        extra.append((number, F.col(column)))
    return detect(out, policy, text, context, extra).drop(*[f"__detector_{n}" for n, _ in extra])


def sentences(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, sid, s, e, sentence``: newlines part, and ``. ! ?`` before white space or the end.

    A full stop does not end a sentence after a digit, a single letter or an abbreviation.
    Blank sentences are left out; the newline belongs to none.
    """
    found = docs.select(key, F.posexplode(match_spans(F.col(text), SENTENCE)).alias("sid", "x"))
    return found.where(F.trim("x.v") != "").select(key, "sid", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.v").alias("sentence"))


REASONS = ("sentenceStartUnknown", "capitalizedUnknown", "listedGivenName", "unknownBigram", "unknownLowerBigram", "nearPersonCue")
#: Names of the lists that a task holds at once; longer lists are joined to the words of each text.
MOST_NAMES = 500_000
#: Different words and gaps whose traits a task remembers.
MOST_KEPT = 200_000
#: Bytes of an Arrow batch between the JVM and Python: a task's arrays follow these.
BATCH_BYTES = 4 << 20
#: What Java takes for white space in its Unicode mode.
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _gate(on: dict, held: Callable[[], dict] | None, whole: bool) -> Callable:
    """The gate over Arrow batches ``key, pieces, words, sentences, cues`` (and names, where ``held`` gives none).

    All steps are arrays over a batch's tokens; words and gaps are looked at once each. Functions
    lie inside, so that workers need not import this package.
    """
    given_to = [bool(on[r]) for r in REASONS]
    reasons, particles, white, least, reach, most_kept = REASONS, frozenset(PARTICLES), WHITE, LEAST_TOKEN, CUE_WINDOW, MOST_KEPT
    SHAPED, TITLE, OUTSIDE, GIVEN, PARTICLE = 1, 2, 4, 8, 16

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        marks = held() if held else None
        kept_words: dict[str, int] = {}
        kept_gaps: dict[str, bool] = {}

        def traits(word: str) -> int:
            name = word.lower().replace("ß", "ss")
            mark = marks.get(name, 0)
            shaped = len(word) >= least and not any(len(p) <= 4 and p == p.upper() for p in word.split("-"))
            title = word[0] != word[0].lower() and word != word.upper()
            return shaped * SHAPED | title * TITLE | (not mark & 1) * OUTSIDE | (mark >> 1 & 1) * GIVEN | (name in particles) * PARTICLE

        def near(gap: str) -> bool:
            return gap != "" and not gap.strip(white) and gap.count("\n") < 2

        def looked_up(values, look, kept, kind):
            """``look`` of each value, called once for each different one."""
            coded = values.dictionary_encode()
            different = coded.dictionary.to_pylist()
            if len(kept) > most_kept:
                kept.clear()
            for v in different:
                if v not in kept:
                    kept[v] = look(v)
            table = np.fromiter((kept[v] for v in different), kind, len(different))
            return table[coded.indices.to_numpy(zero_copy_only=False)]

        def numbers(values):
            return values.to_numpy(zero_copy_only=False).astype(np.int64)

        def laid_out(lists, docs_at):
            """Starts, ends and document of the spans of all texts, and where each text's begin."""
            sizes = numbers(pc.list_value_length(lists))
            flat = lists.flatten()
            return numbers(flat.field(0)), numbers(flat.field(1)), np.repeat(docs_at, sizes), np.cumsum(sizes) - sizes

        for batch in batches:
            if not held:
                listed = batch.column(5).flatten()
                marks = dict(zip(listed.field(0).to_pylist(), listed.field(1).to_pylist(), strict=True))
                kept_words.clear()
            docs_at = np.arange(batch.num_rows)
            sizes = numbers(pc.list_value_length(batch.column(2)))
            n, doc = int(sizes.sum()), np.repeat(docs_at, sizes)
            pieces, words = batch.column(1).flatten(), batch.column(2).flatten()
            if len(pieces) != n + batch.num_rows:
                raise ValueError("pieces and words do not alternate")
            if not n:
                continue
            at = np.arange(n)
            long = numbers(pc.utf8_length(words))
            upto = np.cumsum(numbers(pc.utf8_length(pieces))[at + doc] + long)
            first = np.cumsum(sizes) - sizes
            e = upto - np.concatenate(([0], upto))[first][doc]
            s = e - long
            trait = looked_up(words, traits, kept_words, np.uint8)
            touching = looked_up(pieces, near, kept_gaps, bool)[at + doc + 1]

            # A token's sentence and cue are the last that begin at or before it, if they reach it; a cue may also begin inside it.
            s0, s1, s_doc, s_first = laid_out(batch.column(3), docs_at)
            c0, c1, c_doc, _ = laid_out(batch.column(4), docs_at)
            apart = 2 + max(int(e.max()), int(s1.max(initial=0)), int(c1.max(initial=0)))
            place = s + doc * apart
            own = np.searchsorted(s0 + s_doc * apart, place, "right") - 1
            within = (own >= 0) & (s_doc[own] == doc) & (s < s1[own]) if len(s0) else np.zeros(n, bool)
            own = np.where(within, own, -1)
            cue = np.full(n, -1)
            if len(c0):
                last = np.searchsorted(c0 + c_doc * apart, place, "right") - 1
                after = np.minimum(last + 1, len(c0) - 1)
                inside = (after == last + 1) & (c_doc[after] == doc) & (c0[after] < e)
                cue = np.where(inside, after, -1)
                cue = np.where((last >= 0) & (c_doc[last] == doc) & (s < c1[last]), last, cue)

            def later(k):
                """The token k places on, and whether the text has it."""
                there = np.minimum(at + k, n - 1)
                return there, (at + k < n) & (doc[there] == doc)

            n1, has1 = later(1)
            n2, has2 = later(2)
            link = has1 & (trait[n1] & PARTICLE > 0)
            following = np.where(touching & has1 & ~link, n1, np.where(touching & link & has2 & touching[n1], n2, -1))
            starts = np.ones(n, bool)
            starts[1:] = (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
            other = np.zeros(n, bool)
            if (cue >= 0).any():
                for k in range(1, reach + 1):
                    a, b = slice(0, max(0, n - k)), slice(min(k, n), n)
                    differ = (doc[a] == doc[b]) & (cue[a] != cue[b])
                    other[a] |= differ & (cue[b] >= 0)
                    other[b] |= differ & (cue[a] >= 0)

            shaped, title, outside, given = (trait & bit > 0 for bit in (SHAPED, TITLE, OUTSIDE, GIVEN))
            pair = shaped & (following >= 0) & shaped[following] & (outside | outside[following])
            titles = title & title[following]
            unknown = shaped & title & outside
            tests = (unknown & starts, unknown & ~starts, shaped & given & (title | outside), pair & titles, pair & ~titles, shaped & other & outside)
            found = []  # token, sentence, end, reason
            for number, (wanted, test) in enumerate(zip(given_to, tests, strict=True)):
                if not wanted:
                    continue
                hit = np.flatnonzero(test & (own >= 0))
                two = reasons[number] in ("unknownBigram", "unknownLowerBigram")
                found.append((hit, own[hit], e[following[hit]] if two else e[hit], np.full(len(hit), number)))
                if two:
                    # A pair over a sentence's end marks both.
                    hit = np.flatnonzero(test & (own[following] >= 0) & (own[following] != own))
                    found.append((hit, own[following[hit]], e[following[hit]], np.full(len(hit), number)))
            if not found:
                continue
            token, sentence, end, reason = (np.concatenate(x) for x in zip(*found, strict=True))
            if whole:
                once = np.unique(sentence * len(reasons) + reason)
                sentence, reason = once // len(reasons), once % len(reasons)
            where = s_doc[sentence]
            columns = [
                batch.column(0).take(pa.array(where)),
                pa.array(sentence - s_first[where], pa.int32()),
                pa.array(reasons, pa.string()).take(pa.array(reason)),
            ]
            if not whole:
                columns += [pa.array(s[token], pa.int32()), pa.array(end, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "sid", "reason", "s", "e"][: len(columns)])

    return run


def _suspicious(
    docs: DataFrame, common: DataFrame, given: DataFrame, triggers: dict | None, key: str,
    primary: DataFrame | None, below: float, cues: Iterable[str], whole: bool,
) -> DataFrame:
    on = TRIGGERS | (triggers or {})
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    listed = [rows.select("name").where("name is not null").distinct().withColumn("mark", F.lit(bit)) for bit, rows in ((1, common), (2, given))]
    listed = staged(listed[0].unionByName(listed[1]).groupBy("name").agg(F.sum("mark").cast("int").alias("mark")), "listed-names")

    words = F.regexp_extract_all("text", F.lit(TOKEN.java), F.lit(0))
    places = lambda pattern: F.transform(match_spans(F.col("text"), pattern), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    texts = docs.where("text is not null").select(F.col(key).alias("id"), "text")
    columns = ["id", F.split("text", TOKEN.java, -1).alias("pieces"), words.alias("words"), places(SENTENCE).alias("sentences"), places(rewrite(phrase_pattern(cues))).alias("cues")]
    if listed.count() <= MOST_NAMES:
        shared = spark.sparkContext.broadcast({r.name: r.mark for r in listed.toLocalIterator()})
        rows, held = texts.select(*columns), lambda: shared.value
    else:
        own = texts.select("id", F.explode(F.array_distinct(F.transform(words, casefold_de))).alias("name")).distinct().join(listed, "name")
        own = own.groupBy(F.col("id").alias("__id")).agg(F.collect_list(F.struct("name", "mark")).alias("names"))
        none = F.array().cast("array<struct<name:string,mark:int>>")
        rows = texts.join(own, F.col("id").eqNullSafe(F.col("__id")), "left").select(*columns, F.coalesce("names", none).alias("names"))
        held = None
    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(_gate(on, held, whole), f"id {kind}, sid int, reason string" + ("" if whole else ", s int, e int")).withColumnRenamed("id", key)
    if primary is None or not on["lowConfidence"]:
        return found
    # Hits take their sentence in one ordered pass over both: the last that begins at or before them, if it reaches them.
    marks = sentences(docs, key).select(key, "s", F.lit(0).alias("kind"), F.struct("sid", "e").alias("own"))
    both = marks.unionByName(primary.where(F.col("score") < below).select(key, "s", F.lit(1).alias("kind"), "e"), True)
    line = W.partitionBy(key).orderBy("s", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("own", F.last("own", ignorenulls=True).over(line)).where((F.col("kind") == 1) & (F.col("s") < F.col("own.e")))
    low = both.select(key, F.col("own.sid").alias("sid"), F.lit("lowConfidence").alias("reason"), "s", "e")
    return found.unionByName((low.select(key, "sid", "reason") if whole else low).distinct())


def suspicious_tokens(
    docs: DataFrame, common: DataFrame, given: DataFrame, triggers: dict | None = None, key: str = "id",
    primary: DataFrame | None = None, below: float = LOW_CONFIDENCE, cues: Iterable[str] = CUES,
) -> DataFrame:
    """``key, sid, reason, s, e``: what made a sentence one that the costly model should see.

    A row of docs is a text. common and given are casefolded lists ``name``, gathered when this is
    called; primary holds a first model's hits ``key, s, e, score``, of which those under ``below``
    count. A text's tokens, sentences and cues never leave its task: nothing of them is shuffled.
    """
    return _suspicious(docs, common, given, triggers, key, primary, below, cues, False)


def suspicious_sentences(
    docs: DataFrame, common: DataFrame, given: DataFrame, triggers: dict | None = None, key: str = "id",
    primary: DataFrame | None = None, below: float = LOW_CONFIDENCE, cues: Iterable[str] = CUES,
) -> DataFrame:
    """``key, sid, reason``: sentences that the costly model should see, by trigger (see ``suspicious_tokens``)."""
    return _suspicious(docs, common, given, triggers, key, primary, below, cues, True)


class NerBackend(Protocol):
    """A name model: entities of each text as ``(start, end, label, score or None)``, code points."""

    def __call__(self, texts: list[str]) -> list[list[tuple[int, int, str, float | None]]]: ...


def model_spans(docs: DataFrame, load: Callable[[], NerBackend], labels: Iterable[str], least_score: float = 0.0, key: str = "id") -> DataFrame:
    """``key, s, e, label, score`` from a model that each worker loads once; a model's failure fails the query.

    Scores are compared only where the model gives one.
    """
    wanted = frozenset(labels)
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            rows = [
                (name, s, e, label, score)
                for name, found in zip(frame[key], model([t or "" for t in frame["text"]]), strict=True)
                for s, e, label, score in found
                if label in wanted and (score is None or score >= least_score)
            ]
            yield pd.DataFrame(rows, columns=[key, "s", "e", "label", "score"])

    return docs.select(key, "text").mapInPandas(run, f"{key} {kind}, s int, e int, label string, score double")


def model_windows(docs: DataFrame, hits: DataFrame, most_chars: int = 2000, key: str = "id") -> DataFrame:
    """``key, s, e``: the stretches that the costly model sees: marked sentences whole, of longer ones windows around their hits.

    hits: rows of ``suspicious_tokens``. Windows that touch are joined before they are cut, so a name lies
    whole in one unless its hits spread over more than ``most_chars``.
    """
    own = hits.select(key, "sid", F.col("s").alias("hs"), F.col("e").alias("he"))
    rows = sentences(docs, key).select(key, "sid", "s", "e").join(own, [key, "sid"])
    short = rows.where(F.col("e") - F.col("s") <= most_chars).select(key, "s", "e").distinct()
    middle = F.floor((F.greatest("hs", "s") + F.least("he", "e")) / 2).cast("int")
    end = F.least(F.col("e"), F.greatest(F.col("s"), middle - most_chars // 2) + most_chars)
    long = rows.where(F.col("e") - F.col("s") > most_chars)
    long = long.select(key, "sid", F.greatest(F.col("s"), end - most_chars).alias("w"), end.alias("e")).withColumnRenamed("w", "s").distinct()
    named = long.withColumn("id", F.struct(key, "sid")).select("id", "s", "e")
    cut = merge_windows(named, most_chars, "id").select(F.col(f"id.{key}").alias(key), "s", "e")
    return short.unionByName(cut)


def cascade(docs: DataFrame, hits: DataFrame, load: Callable[[], NerBackend], labels: Iterable[str], least_score: float, most_chars: int = 2000, key: str = "id") -> DataFrame:
    """The costly model over suspicious stretches only: ``key, s, e, label, score`` in document offsets."""
    kind = docs.schema[key].dataType.simpleString()
    windows = model_windows(docs, hits, most_chars, key).join(docs.select(key, "text"), key)
    named = windows.select(F.to_json(F.struct(key, F.col("s").alias("base"))).alias("id"), F.substr("text", F.col("s") + 1, F.col("e") - F.col("s")).alias("text"))
    found = model_spans(named, load, labels, least_score).withColumn("p", F.from_json("id", f"{key} {kind}, base int"))
    return found.select(F.col(f"p.{key}").alias(key), (F.col("s") + F.col("p.base")).alias("s"), (F.col("e") + F.col("p.base")).alias("e"), "label", "score").distinct()


def merge_windows(windows: DataFrame, most_chars: int, key: str = "id") -> DataFrame:
    """Overlapping windows joined, then cut to ``most_chars``: gaps and islands."""
    order = W.partitionBy(key).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = windows.withColumn("new", (before.isNull() | (F.col("s") > before)).cast("int"))
    islands = marked.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = islands.groupBy(key, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    cut = whole.select(key, "e", F.explode(F.sequence("s", F.greatest(F.col("e") - 1, F.col("s")), F.lit(most_chars))).alias("s"))
    return cut.select(key, "s", F.least("e", F.col("s") + most_chars).alias("e"))


NAME = rf"[{LETTERS}]+(?:[-' ][{LETTERS}]+)*"


def build_name_list(sources: Iterable[tuple[DataFrame, int]], stop: Iterable[str] = STOP_WORDS) -> DataFrame:
    """A list ``name`` of several open ones (rows ``name``, least length): trimmed, shaped like names, no stop word, each once, in order."""
    parts = [rows.select(F.trim("name").alias("name")).where(F.length("name") >= least) for rows, least in sources]
    names = reduce(lambda a, b: a.unionByName(b), parts)
    names = names.where(F.col("name").rlike(f"^{NAME}$") & ~casefold_de(F.col("name")).isin(*stop)).distinct()
    return names.orderBy(casefold_de(F.col("name")), "name")
