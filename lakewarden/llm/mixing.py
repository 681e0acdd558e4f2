"""Operator 6: mixing sources to target weights by hash-threshold histograms.

Each document has a fixed uniform hash. Per source, tokens are summed by the
leading hash digits; the bucket in which the running sum crosses the budget is
found, and only that boundary bucket is summed again by the next digits. After
the last level the threshold is exact to one hash value, so the taken tokens come within
half a document of the budget (half of what one hash value holds: rows that repeat an id,
or lack one and repeat a text, share a hash and go together). Documents are chosen by comparing their
hash with the threshold: nothing sorts documents, and thresholds are nested, so
a larger budget only adds documents.

A budget over the source's size takes whole copies of every document first; the
threshold decides the remaining copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.llm.shared import absent, quoted, written

#: Hex digits of the hash at each refinement level (12 digits, 48 bits in all).
LEVELS = (4, 4, 4)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def doc_hash(seed: int, key: Column, content: Column) -> Column:
    """48 uniform bits from md5, the same in any SQL engine; rows without an id are told apart by their text."""
    own = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(content, F.lit("")))))
    text = F.concat_ws(":", F.lit(str(seed)), own)
    return F.conv(F.substring(F.md5(text), 1, sum(LEVELS)), 16, 10).cast("long")


def water_fill(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Targets for ``(__source, __size, __weight)``: add ``target``.

    All sizes are shared by weight; no target passes ``cap`` times its source's
    size, and what is cut off goes to the others by weight, again and again. The
    fixed point is ``min(cap * size, level * weight)`` with one level for all, and
    is found in closed form: in order of ``size / weight`` the capped sources come
    first, so running sums name the first level that caps no later source.
    """
    order = W.orderBy(F.col("__size") / F.col("__weight"), F.col("__source").asc_nulls_last())
    past = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("__size").over(everything) - F.lit(cap) * F.coalesce(F.sum("__size").over(past), F.lit(0))) / F.sum(
        "__weight"
    ).over(rest)
    tried = sources.withColumn("__level", level.cast("double"))
    fits = F.col("__level") * F.col("__weight") <= F.lit(cap) * F.col("__size")
    # The first source in order that fits under its level fixes the level for all.
    best = F.min(F.when(fits, F.struct((F.col("__size") / F.col("__weight")).alias("q"), "__level"))).over(everything)
    found = tried.withColumn("__level", best.getField("__level"))
    capped = F.lit(cap) * F.col("__size")
    target = F.when(F.col("__level").isNull(), capped).otherwise(F.least(capped, F.col("__level") * F.col("__weight")))
    return found.withColumn("target", target.cast("double")).drop("__level")


def _boundary(docs: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """One refinement level: the boundary bucket of each source and what is left of its budget.

    docs: ``__source, __h, size`` within the present boundary; budgets:
    ``__s, __left, __low`` (what may still be taken, all hashes below ``__low`` taken).
    """
    digit = F.shiftright(F.col("__h"), shift)
    histogram = docs.groupBy("__source", digit.alias("__bucket")).agg(F.sum("size").alias("__tokens"))
    running = W.partitionBy("__source").orderBy("__bucket")
    sums = histogram.withColumn("__upto", F.sum("__tokens").over(running)).join(
        budgets, F.col("__source").eqNullSafe(F.col("__s"))
    )
    over = F.col("__upto") > F.col("__left")
    first_over = F.min(F.when(over, F.col("__bucket")))
    if not shift:
        # The last bucket is one hash value: take it too where that ends nearer the budget.
        before = F.coalesce(F.max(F.when(~over, F.col("__upto"))), F.lit(0))
        after = F.min(F.when(over, F.col("__upto")))
        left = F.first("__left")
        first_over = first_over + F.when(after - left < left - before, 1).otherwise(0)
    taken = F.coalesce(F.sum(F.when(~over, F.col("__tokens"))), F.lit(0))
    return sums.groupBy(F.col("__source").alias("__s")).agg(
        (F.first("__left") - taken).alias("__left"),
        F.shiftleft(first_over, shift).alias("__low"),
        F.shiftleft(first_over + 1, shift).alias("__high"),
    )


def _planned(docs: DataFrame, seed: int, cap: int, id_column: str, source_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Sizes ``doc_id, __source, size, __h`` of all rows, and each source's plan, both written.

    Plan: ``__s, source_size, target``, whole copies of every row (``__whole``), and the hash under
    which rows are taken once more (``__theta``, null for all) where ``__left`` is above 0.
    """
    sized = written(
        docs.select(
            F.col(quoted(id_column)).alias("doc_id"),
            F.col(quoted(source_column)).alias("__source"),
            word_count(F.col(quoted(text_column))).alias("size"),
            doc_hash(seed, F.col(quoted(id_column)), F.col(quoted(text_column))).alias("__h"),
        ),
        "mix-sizes",
    )
    by_name = W.orderBy(F.col("__source").asc_nulls_last())
    sources = sized.groupBy("__source").agg(F.sum("size").alias("__size"))
    sources = sources.withColumn("__weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    sources = (
        water_fill(sources, float(cap))
        .withColumn("__whole", F.when(F.col("__size") > 0, F.floor(F.col("target") / F.col("__size"))).otherwise(0))
        .withColumn("__left", F.floor(F.col("target") - F.col("__whole") * F.col("__size")).cast("long"))
    )
    sources = written(sources.withColumnRenamed("__source", "__s"), "mix-sources")

    digits, theta = sum(LEVELS), None
    budgets = sources.select("__s", "__left")
    inside = sized.select("__source", "__h", "size")
    for width in LEVELS:
        digits -= width
        found = written(_boundary(inside, budgets, 4 * digits), "mix-bounds")
        budgets = found.select("__s", "__left")
        last = found.select(F.col("__s").alias("__t"), F.col("__low").alias("__theta"))
        theta = last if theta is None else _narrow(theta, last)
        # A source whose budget covers all it has leaves the refinement here.
        edge = found.where("__low is not null").select(F.col("__s").alias("__e"), "__low", "__high")
        within = (F.col("__h") >= F.col("__low")) & (F.col("__h") < F.col("__high"))
        inside = inside.join(_sized(edge), F.col("__source").eqNullSafe(F.col("__e")) & within)
        inside = inside.select("__source", "__h", "size")
    plan = sources.join(theta, F.col("__s").eqNullSafe(F.col("__t")), "left").select(
        "__s", F.col("__size").alias("source_size"), "target", "__whole", "__theta", "__left"
    )
    return sized, written(plan, "mix-plan")


def _copies(h: Column, theta: Column, whole: Column, left: Column) -> Column:
    chosen = F.when(left > 0, F.coalesce(h < theta, F.lit(True))).otherwise(False)
    return (whole + chosen.cast("long")).cast("long")


def mix(
    docs: DataFrame,
    seed: int = 29,
    cap: int = 3,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """``doc_id, size, source_size, target, copies`` per input row.

    Sources by code point, null last, weigh 1, 2, 3, repeating. Null texts have
    size 0. Rows with equal ids (or none and equal texts) have equal hashes and so stay or
    go together; a source of size 0 has target 0 and takes none of its documents. An
    empty table gives an empty result. Other columns are not read.
    """
    sized, plan = _planned(docs, seed, cap, id_column, source_column, text_column)
    return sized.join(_sized(plan), F.col("__source").eqNullSafe(F.col("__s"))).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        _copies(F.col("__h"), F.col("__theta"), F.col("__whole"), F.col("__left")).alias("copies"),
    )


def mixed(
    docs: DataFrame,
    seed: int = 29,
    cap: int = 3,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, all columns as they were.

    Every row is decided by its own source and hash, so repeated ids and ids that are null cost no row.
    """
    _, plan = _planned(docs, seed, cap, id_column, source_column, text_column)
    names = {c: absent(docs, f"__mix{c}") for c in ("__s", "__theta", "__whole", "__left", "__h", "__n")}
    plan = plan.select(*[F.col(c).alias(names[c]) for c in ("__s", "__theta", "__whole", "__left")])
    col = {c: F.col(n) for c, n in names.items()}
    hashed = docs.withColumn(names["__h"], doc_hash(seed, F.col(quoted(id_column)), F.col(quoted(text_column))))
    taken = hashed.join(_sized(plan), F.col(quoted(source_column)).eqNullSafe(col["__s"]))
    taken = taken.withColumn(names["__n"], _copies(col["__h"], col["__theta"], col["__whole"], col["__left"])).where(col["__n"] > 0)
    own = [F.col(quoted(c)) for c in docs.columns]
    repeated = taken.select(*own, F.explode(F.sequence(F.lit(1), col["__n"].cast("int"))).alias(names["__n"]))
    return repeated.select(*own)


def _narrow(theta: DataFrame, finer: DataFrame) -> DataFrame:
    """Thresholds after one more level; a source that the finer level lacks keeps its own."""
    new = finer.withColumnRenamed("__t", "__u").withColumnRenamed("__theta", "__finer")
    return theta.join(new, F.col("__t").eqNullSafe(F.col("__u")), "left").select(
        "__t", F.coalesce("__finer", "__theta").alias("__theta")
    )


#: Sources up to which the plan (a row of a few numbers for each) is broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def _sized(table: DataFrame) -> DataFrame:
    """``table`` with a broadcast hint only where its rows are few enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(
        "doc_id",
        "size",
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )
