"""Spans of pattern matches, their resolution and replacement, in code points.

A match's offset follows from the lengths of what lies between matches: splitting and
extracting by the same pattern walk the same matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakewarden.functions.expressions import CHECKSUMS, let

PLACEHOLDER = r"<([A-Z][A-Z_]*)_([0-9]+)>"
CHUNK = 128
SPAN = "array<struct<s:int,e:int,v:string>>"


@dataclass(frozen=True)
class Pattern:
    """A Java pattern, and which groups hold the text before the span and the span (0: the whole match)."""

    java: str
    before: int = 0
    value: int = 0


def rewrite(pattern: str) -> Pattern:
    """A Python pattern in Java's dialect; a group ``pii`` narrows the span.

    Patterns that match the empty string are refused, as is a ``pii`` group inside
    another group (its offset could not be told).
    """
    if re.search(pattern, "") is not None:
        raise ValueError(f"pattern matches the empty string: {pattern}")
    java = pattern.replace(r"[^\W\d_]", r"[\p{L}\p{Nl}\p{No}]")
    flags = ""
    while found := re.match(r"\(\?([a-z]+)\)", java):
        flags += found.group(1)
        java = java[found.end() :]
    if re.search(r"\\[bswdBSWD]", java):
        flags += "U"
    if "i" in flags and "U" not in flags:
        flags += "u"
    lead = f"(?{flags})" if flags else ""
    if "(?P<pii>" not in java:
        return Pattern(lead + re.sub(r"\(\?P<(\w+)>", r"(?<\1>", java))
    prefix, rest = java.split("(?P<pii>", 1)
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", prefix)
    if plain.count("(") != plain.count(")"):
        raise ValueError(f"the pii group must not lie inside another group: {pattern}")
    inner = len(re.findall(r"\((?!\?)", plain))
    return Pattern(f"{lead}({prefix})(?<pii>{rest}", 1, inner + 2)


def scan(rows: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], item: str) -> Column:
    """What ``step(state, row)`` makes of each row as it passes a state along: an array of type ``item``.

    ``rows`` is named in every chunk: it must be a column or bound by ``let``. Appending copies an array, so items gather in chunks and the chunks are flattened once.
    """
    none = F.array().cast(f"array<{item}>")

    def add(state: Column, row: Column) -> Column:
        after, made = step(state["st"], row)
        pair = F.struct(after.alias("st"), made.alias("item"))
        return let(pair, lambda p: F.struct(p["st"].alias("st"), F.concat(state["out"], F.array(p["item"])).alias("out")))

    def chunk(state: Column, first: Column) -> Column:
        walked = F.aggregate(F.slice(rows, first, F.lit(CHUNK)), F.struct(state["st"].alias("st"), none.alias("out")), add)
        return let(walked, lambda w: F.struct(w["st"].alias("st"), F.concat(state["out"], F.array(w["out"])).alias("out")))

    begin = F.struct(start.alias("st"), F.array().cast(f"array<array<{item}>>").alias("out"))
    firsts = F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(CHUNK))
    return F.aggregate(firsts, begin, chunk, lambda s: F.flatten(s["out"]))


def match_spans(text: Column, pattern: Pattern) -> Column:
    """All non-overlapping matches as ``array<struct<s, e, v>>``; null text has none."""
    empty = F.array().cast(SPAN)

    def place(at: Column, row: Column) -> tuple[Column, Column]:
        start = at + F.length(row["b"])
        own = start + F.length(row["p"]) if pattern.value else start
        value = row["g"] if pattern.value else row["m"]
        return start + F.length(row["m"]), F.struct(own.alias("s"), (own + F.length(value)).alias("e"), value.alias("v"))

    def walk(matches: Column) -> Column:
        pieces = F.split(text, pattern.java, -1)
        parts = [F.slice(pieces, F.lit(1), F.size(matches)).alias("b"), matches.alias("m")]
        if pattern.value:
            parts += [F.regexp_extract_all(text, F.lit(pattern.java), F.lit(i)).alias(n) for i, n in ((pattern.before, "p"), (pattern.value, "g"))]
        return let(F.arrays_zip(*parts), lambda rows: scan(rows, F.lit(0), place, "struct<s:int,e:int,v:string>"))

    matches = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))
    found = let(matches, lambda m: F.when(F.size(m) > 0, walk(m)).otherwise(empty))
    return F.when(text.isNull(), empty).otherwise(found)


def longest_valid(text: Column, spans: Column, checksum: str) -> Column:
    """Each span cut to its longest prefix that passes the checksum and ends at a token boundary; others go.

    The prefix must end on a letter or digit which none follows in the text. An account
    number shorter than 15 characters without blanks ends the search.
    """
    ok = CHECKSUMS[checksum]
    word = r"[\p{L}\p{N}]"

    def cut(x: Column) -> Column:
        def fits(n: Column) -> Column:
            value = F.substr(x["v"], F.lit(1), n)
            ends = F.substr(value, n, F.lit(1)).rlike(word)
            goes_on = F.substr(text, x["s"] + n + 1, F.lit(1)).rlike(word)
            long_enough = F.length(F.replace(value, F.lit(" "), F.lit(""))) >= (15 if checksum == "iban-mod97" else 1)
            return ends & ~goes_on & long_enough & ok(value)

        lengths = F.sequence(F.length(x["v"]), F.lit(1), F.lit(-1))
        best = F.get(F.filter(lengths, fits), F.lit(0))
        return let(best, lambda n: F.struct(x["s"].alias("s"), (x["s"] + n).alias("e"), F.substr(x["v"], F.lit(1), n).alias("v")))

    return F.filter(F.transform(spans, cut), lambda x: x["e"].isNotNull())


def resolve(candidates: Column) -> Column:
    """Greedy overlap resolution of ``array<struct<s, e, v, rank, det, pat, entity>>``.

    Longest first, then the higher entity rank, the earlier start, and the order of
    detectors and patterns; a span stays if it is disjoint from all that stayed. The
    result is ordered by start.
    """

    def key(x: Column) -> Column:
        return F.struct((x["s"] - x["e"]).alias("a"), (-x["rank"]).alias("b"), x["s"].alias("c"), x["det"], x["pat"], x.alias("span"))

    def take(chosen: Column, x: Column) -> Column:
        clash = F.exists(chosen, lambda c: (x["s"] < c["e"]) & (c["s"] < x["e"]))
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(x)))

    def greedy(spans: Column) -> Column:
        ranked = F.transform(F.array_sort(F.transform(spans, key)), lambda k: k["span"])
        return let(ranked, lambda r: F.aggregate(r, F.slice(r, 1, 0), take))

    def by_start(spans: Column) -> Column:
        return F.array_sort(spans, lambda a, b: (a["s"] - b["s"]).cast("int"))

    def alone(spans: Column) -> Column:
        """Which of the spans (by start) touch no other: no earlier one reaches in, no later one begins inside."""
        reach = scan(spans, F.lit(-1), lambda most, x: (F.greatest(most, x["e"]), most), "int")
        return F.transform(F.arrays_zip(reach.alias("most"), spans.alias("x")), lambda r, i: (r["most"] <= r["x"]["s"]) & (F.coalesce(F.get(spans, i + 1)["s"] >= r["x"]["e"], F.lit(True))))

    def split(spans: Column) -> Column:
        # Most spans meet no other one; only the rest are compared with one another.
        def parts(free: Column) -> Column:
            kept = F.filter(spans, lambda x, i: F.get(free, i))
            rest = F.filter(spans, lambda x, i: ~F.get(free, i))
            return F.when(F.size(kept) == F.size(spans), spans).otherwise(by_start(F.concat(kept, greedy(rest))))

        return let(alone(spans), parts)

    return let(candidates, lambda c: F.when(F.size(c) < 2, c).otherwise(let(by_start(c), split)))


def splice(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """``text`` with each of the disjoint, ordered spans replaced; null and empty texts pass through."""

    def piece(at: Column, x: Column) -> tuple[Column, Column]:
        return x["e"], F.concat(F.substr(text, at + 1, x["s"] - at), replacement(x))

    def rebuilt(own: Column) -> Column:
        pieces = F.array_join(scan(own, F.lit(0), piece, "string"), "")
        whole = F.concat(pieces, F.substr(text, F.element_at(own, -1)["e"] + 1))
        return F.when(F.size(own) > 0, whole).otherwise(text)

    return let(spans, rebuilt)
