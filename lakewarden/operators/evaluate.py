"""Detection quality: recall, precision, character coverage, latency, gates and levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.functions.expressions import ratio


def span_outcomes(gold: DataFrame, predicted: DataFrame, texts: DataFrame) -> DataFrame:
    """Each gold span ``id, s, e, type`` with ``strict, masked, partial``.

    Masked: every non-blank character lies in predicted spans of any type (which are
    disjoint), and there is one. Partial: some but not all. The overlap join has the
    document as its equi key and the interval test as a residual.
    """
    g = gold.withColumn("gid", F.xxhash64("id", "s", "e", "type"))
    p = predicted.select(F.col("id").alias("pid"), F.col("s").alias("ps"), F.col("e").alias("pe"), F.col("type").alias("ptype"))
    over = (F.col("id") == F.col("pid")) & (F.col("ps") < F.col("e")) & (F.col("s") < F.col("pe"))
    pairs = g.join(p, over, "left").join(texts.select(F.col("id").alias("tid"), "text"), F.col("id") == F.col("tid"))
    inside = F.substr(F.col("text"), F.greatest("s", "ps") + 1, F.least("e", "pe") - F.greatest("s", "ps"))
    solid = lambda c: F.length(F.regexp_replace(c, r"(?U)\s", ""))
    whole = solid(F.substr(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")))
    same = (F.col("s") == F.col("ps")) & (F.col("e") == F.col("pe")) & (F.col("type") == F.col("ptype"))
    extra = [c for c in gold.columns if c not in ("id", "s", "e", "type")]
    out = pairs.groupBy("gid", "id", "s", "e", "type", *extra).agg(
        F.max(F.coalesce(same, F.lit(False))).alias("strict"),
        F.coalesce(F.sum(solid(inside)), F.lit(0)).alias("covered"),
        F.max(whole).alias("whole"),
    )
    masked = (F.col("whole") > 0) & (F.col("covered") >= F.col("whole"))
    return out.select("id", "s", "e", "type", *extra, "strict", masked.alias("masked"), (~masked & (F.col("covered") > 0)).alias("partial"))


def type_metrics(gold: DataFrame, predicted: DataFrame, texts: DataFrame, types: list[str]) -> DataFrame:
    """Per type: counts, strict and masked recall, precision (any overlap with gold of its own type counts)."""
    outcomes = span_outcomes(gold, predicted, texts)
    flag = lambda c: F.count_if(F.col(c)).alias(c)
    recall = outcomes.groupBy("type").agg(F.count(F.lit(1)).alias("gold"), flag("strict"), flag("masked"), flag("partial"))
    g = gold.select(F.col("id").alias("gid"), F.col("s").alias("gs"), F.col("e").alias("ge"), F.col("type").alias("gtype"))
    over = (F.col("id") == F.col("gid")) & (F.col("type") == F.col("gtype")) & (F.col("s") < F.col("ge")) & (F.col("gs") < F.col("e"))
    counted = predicted.where(F.col("type").isin(types))
    right = counted.join(g, over, "left_semi").groupBy("type").agg(F.count(F.lit(1)).alias("pred_ok"))
    every = counted.groupBy("type").agg(F.count(F.lit(1)).alias("pred"))
    # The sides are a row for each type; a union keeps the join from losing its key where the type is constant.
    parts = [recall, every, right]
    zero = {c: F.lit(0).cast("long") for c in ("gold", "strict", "masked", "partial", "pred", "pred_ok")}
    rows = [p.select("type", *[F.col(c) if c in p.columns else v.alias(c) for c, v in zero.items()]) for p in parts]
    out = union_all(rows).groupBy("type").agg(*[F.sum(c).alias(c) for c in zero])
    return out.select(
        "type", "gold", "strict", "masked", "partial", "pred", "pred_ok",
        ratio(F.col("strict"), F.col("gold")).alias("recall_strict"),
        ratio(F.col("masked"), F.col("gold")).alias("recall_masked"),
        ratio(F.col("pred_ok"), F.col("pred")).alias("precision"),
    )


def latency(times: DataFrame, column: str = "ms", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean and nearest-rank 95th percentile, by groups if any are named."""
    return times.groupBy(*by).agg(F.bround(F.avg(column), 2).alias("mean_ms"), F.expr(f"percentile_disc(0.95) within group (order by {column})").alias("p95_ms"))


def gate_failures(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """Gates ``type, recall_masked`` not reached (a missing type fails)."""
    got = metrics.select("type", F.col("recall_masked").alias("got"))
    joined = gates.join(got, "type", "left")
    return joined.where(F.col("got").isNull() | (F.col("got") < F.col("recall_masked") - 1e-9)).select("type", "recall_masked", "got")


def levels(results: DataFrame, order: list[str]) -> DataFrame:
    """``level, own, reached``: a level holds if it has MUST tests, none failed or skipped, and all before hold."""
    must = F.col("requirement") == "MUST"
    bad = must & F.col("outcome").isin("failed", "skipped")
    own = results.groupBy("level").agg((F.count_if(must) > 0).alias("has"), (F.count_if(bad) == 0).alias("clean"))
    place = F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)])
    own = own.withColumn("i", place[F.col("level")]).withColumn("own", F.col("has") & F.col("clean"))
    return own.withColumn("reached", F.min("own").over(W.orderBy("i"))).select("level", "own", "reached")


def trigger_stats(reasons: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sentences, triggered ones, their share, and how many each reason marked."""
    every = sentences.agg(F.count(F.lit(1)).alias("sentences"))
    hit = reasons.agg(F.count_distinct("id", "sid").alias("triggered"))
    by = reasons.select("id", "sid", "reason").distinct().groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = every.join(F.broadcast(hit)).withColumn("share", ratio(F.col("triggered"), F.col("sentences")))
    return by.join(F.broadcast(total))


def outcome_summary(results: DataFrame) -> DataFrame:
    """``outcome, n``: how many results ended how."""
    return results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
