"""Detection and masking: spans, overlap resolution, placeholders and their reversal."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lakewarden.functions.spans import PLACEHOLDER, Pattern, longest_valid, match_spans, resolve, splice
from lakewarden.operators.policy import Detector, Policy
from lakewarden.operators.staged import staged

CANDIDATE = "array<struct<s:int,e:int,v:string,rank:int,det:int,pat:int,entity:string>>"


def detector_spans(text: Column, detector: Detector) -> Column:
    """A rule detector's spans over all its patterns, in pattern order."""
    parts = []
    for number, pattern in enumerate(detector.patterns):
        spans = match_spans(text, pattern)
        if detector.kind == "checksum":
            spans = longest_valid(text, spans, detector.checksum)
        spans = _numbered(spans, number)
        if detector.literal:
            # A text without a literal that every match holds is not searched at all.
            spans = F.when(F.contains(text, F.lit(detector.literal)), spans).otherwise(F.array().cast("array<struct<s:int,e:int,v:string,pat:int>>"))
        parts.append(spans)
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _numbered(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), F.lit(number).alias("pat")))


def _tagged(spans: Column, rank: int, det: int, entity: str) -> Column:
    def tag(x: Column) -> Column:
        return F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            x["v"].alias("v"),
            F.lit(rank).alias("rank"),
            F.lit(det).alias("det"),
            x["pat"].alias("pat"),
            F.lit(entity).alias("entity"),
        )

    return F.transform(spans, tag)


def candidates(text: Column, policy: Policy, context: str, extra: Iterable[tuple[int, Column]] = ()) -> Column:
    """All detectors' spans for one context; what is itself a placeholder is dropped.

    ``extra`` adds spans ``array<struct<s, e, v, pat>>`` of detectors (by number) that
    are not rules: name models and name lists.
    """
    parts = []
    for number, detector in enumerate(policy.detectors):
        if context in detector.contexts and detector.kind in ("regex", "checksum"):
            parts.append(_tagged(detector_spans(text, detector), policy.entity_rank(detector.entity), number, detector.entity))
    for number, spans in extra:
        detector = policy.detectors[number]
        if context in detector.contexts:
            parts.append(_tagged(spans, policy.entity_rank(detector.entity), number, detector.entity))
    if not parts:
        return F.array().cast(CANDIDATE)
    return F.filter(F.concat(*parts), lambda x: ~x["v"].rlike(f"^{PLACEHOLDER}$"))


def detect(rows: DataFrame, policy: Policy, text: str = "text", context: str = "prompt", extra=()) -> DataFrame:
    """``rows`` with ``spans`` added: resolved, disjoint, ordered by start."""
    return rows.withColumn("spans", resolve(candidates(F.col(text), policy, context, extra)))


def entity_set(spans: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["entity"])))


def span_rows(found: DataFrame, *keys: str) -> DataFrame:
    """``keys, s, e, value, entity, det, pat``, a row for each span.

    The empty arrays are dropped after they are exploded: a filter before would make the
    optimizer detect everything once more to learn the arrays' sizes.
    """
    x = found.select(*keys, F.explode_outer("spans").alias("x")).where("x is not null")
    return x.select(*keys, "x.s", "x.e", F.col("x.v").alias("value"), "x.entity", "x.det", "x.pat")


def mask_without_vault(text: Column, spans: Column, strategy: str) -> Column:
    """Masking that needs no numbering: ``redact`` or ``hash`` for every span."""

    def mark(x: Column) -> Column:
        if strategy == "redact":
            return F.concat(F.lit("<"), x["entity"], F.lit("_REDACTED>"))
        return F.concat(F.lit("<"), x["entity"], F.lit("_"), F.substr(F.sha2(x["v"], 256), F.lit(1), F.lit(10)), F.lit(">"))

    return splice(text, spans, mark)


def vault(found: DataFrame, policy: Policy, request: str = "request_id", order: tuple[str, ...] = ("msg_idx",)) -> DataFrame:
    """One row for each distinct value of a request: its placeholder and who may see it again.

    The detector that first produced the value decides strategy and format. Numbers
    count placeholder values by entity, in order of first occurrence over messages; the
    same value keeps its number. Grouping happens before numbering, so a window holds
    distinct values, not occurrences. ``found`` is read once more by whoever masks: stage it.
    """
    first = span_rows(found, request, *order).groupBy(request, "entity", "value").agg(
        F.min(F.struct(*order, "s", "det")).alias("first"),
        F.count(F.lit(1)).alias("occurrences"),
    )
    table = [
        F.struct(
            F.lit(d.strategy).alias("strategy"),
            F.lit(d.placeholder).alias("format"),
            F.lit(d.reversible).alias("reversible"),
            F.array(*map(F.lit, d.demask_for)).cast("array<string>").alias("demask_for"),
        )
        for d in policy.detectors
    ]
    kept = first.withColumn("own", F.element_at(F.array(*table), F.col("first.det") + 1))
    numbered = F.col("own.strategy") == "placeholder"
    count = F.row_number().over(W.partitionBy(request, "entity", numbered).orderBy("first"))
    entity = F.col("entity")
    placeholder = (
        F.when(F.col("own.strategy") == "redact", F.concat(F.lit("<"), entity, F.lit("_REDACTED>")))
        .when(F.col("own.strategy") == "hash", F.concat(F.lit("<"), entity, F.lit("_"), F.substr(F.sha2("value", 256), F.lit(1), F.lit(10)), F.lit(">")))
        .otherwise(F.replace(F.col("own.format"), F.lit("{n}"), F.col("n").cast("string")))
    )
    return kept.withColumn("n", F.when(numbered, count)).select(
        request, "entity", "value", placeholder.alias("placeholder"), "n", "occurrences",
        (F.col("own.reversible") & numbered).alias("reversible"), F.col("own.demask_for").alias("demask_for"),
    )


_MARKS = "array<struct<s:int,e:int,placeholder:string>>"


def _spliced(rows: DataFrame, marks: DataFrame, keys: list[str], text: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the marks ``keys, s, e, placeholder`` put in the place of what they cover."""
    gathered = marks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "placeholder"))).alias("__marks"))
    joined = rows.join(gathered, keys, "left")
    none = F.array().cast(_MARKS)
    return joined.withColumn(out, splice(F.col(text), F.coalesce("__marks", none), lambda x: x["placeholder"])).drop("__marks")


def mask(found: DataFrame, keys: list[str], table: DataFrame, request: str = "request_id", text: str = "text") -> DataFrame:
    """``found`` with ``masked``: every span replaced by its vault placeholder. ``keys`` name a message."""
    spans = span_rows(found, *keys).select(*keys, "s", "e", "entity", "value")
    marks = spans.join(table.select(request, "entity", "value", "placeholder"), [request, "entity", "value"])
    return _spliced(found, marks, keys, text, "masked")


def mask_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, entity, n``: what masking a message adds to its request's counts; entities without any are left out."""
    return span_rows(found, *keys).groupBy(*keys, "entity").agg(F.count(F.lit(1)).alias("n"))


def demask(rows: DataFrame, table: DataFrame, roles: Column, keys: list[str], request: str = "request_id", text: str = "masked") -> DataFrame:
    """``rows`` with ``restored``: known, reversible placeholders that the roles may see, in one pass.

    Only the placeholders that a row holds meet the vault, so a request with a large vault
    costs its rows nothing. A value that looks like a placeholder is not expanded again.
    """
    held = match_spans(F.col(text), Pattern(PLACEHOLDER))
    marks = rows.select(*keys, roles.alias("__roles"), F.explode_outer(held).alias("x")).where("x is not null")
    marks = marks.select(*keys, "__roles", "x.s", "x.e", F.col("x.v").alias("placeholder"))
    # Several values of an entity may share a placeholder only where it cannot be reversed.
    known = table.where("reversible").select(request, "placeholder", F.col("value").alias("__value"), "demask_for")
    back = marks.join(known, [request, "placeholder"]).where(F.arrays_overlap("demask_for", "__roles"))
    return _spliced(rows, back.select(*keys, "s", "e", F.col("__value").alias("placeholder")), keys, text, "restored")


def egress_hits(rows: DataFrame, policy: Policy, text: str, context: str = "prompt") -> DataFrame:
    """What a fresh detection still finds in masked text: ``hits`` must be 0."""
    return rows.withColumn("hits", F.size(resolve(candidates(F.col(text), policy, context))))


#: Values that are searched for at once; more take another pass over the texts.
VALUES_AT_ONCE = 500_000


def leaks(texts: DataFrame, table: DataFrame, text: str = "masked") -> DataFrame:
    """Sensitive values that occur anywhere in a text: ``value, n_texts``; empty values occur nowhere.

    Plain containment, whatever the value's length, alphabet or neighbours: all values of a
    block make one automaton, each text passes it once, and what a task has found is counted
    before the shuffle. The values come in blocks of at most ``VALUES_AT_ONCE``, by hash.
    """
    values = staged(table.select("value").where("value <> ''").distinct(), "leak-values")
    blocks = max(1, -(-values.count() // VALUES_AT_ONCE))
    context = texts.sparkSession.sparkContext
    found = None
    for number in range(blocks):
        own = values.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == number)
        shared = context.broadcast([r.value for r in own.toLocalIterator()])

        def run(batches, shared=shared):
            import ahocorasick

            search = ahocorasick.Automaton()
            for i, value in enumerate(shared.value):
                search.add_word(value, i)
            if len(search):
                search.make_automaton()
            for batch in batches:
                counts: Counter[int] = Counter()
                for held in batch.column(0).to_pylist() if len(search) else ():
                    if held:
                        counts.update({i for _, i in search.iter(held)})
                yield pa.RecordBatch.from_arrays([pa.array([shared.value[i] for i in counts], pa.string()), pa.array(counts.values(), pa.int64())], names=["value", "n"])

        part = texts.select(text).mapInArrow(run, "value string, n long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("value").agg(F.sum("n").alias("n_texts"))


def detector_registry(policy: Policy) -> dict[str, Callable[[Column], Column]]:
    """Each rule detector by id, as a function from a text column to its spans."""
    return {d.id: (lambda text, d=d: detector_spans(text, d)) for d in policy.detectors if d.kind in ("regex", "checksum")}


@udtf(returnType="s int, e int, entity string, value string")
class ExplodeSpans:
    """A table function for SQL: the spans of an array column as rows, in order of start."""

    def eval(self, spans: list):
        for x in sorted(spans or (), key=lambda x: (x["s"], x["e"])):
            yield x["s"], x["e"], x["entity"], x["v"]


def register(spark: SparkSession) -> None:
    """Makes ``explode_spans(spans)`` known to SQL."""
    spark.udtf.register("explode_spans", ExplodeSpans)
