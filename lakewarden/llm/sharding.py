"""Operator 4: sharding by proportional stratified interleaving.

Rows of each source get a rank under a seeded shuffle; the fractional rank
``(2 * rank - 1) / (2 * rows of the source)`` spreads every source evenly over
(0, 1). Sorting all rows by it and cutting the order into equal counts gives
shards which all have the mixture of the whole.

No step ranks a source, or the whole table, in one task. Both rankings are two
level: rows fall into buckets of about ``bucket_rows`` by a uniform key, bucket
counts (a small table) are summed up to offsets, and only the rows within a
bucket are ordered by a window.

Law: ``rows`` (shard counts are at most one apart).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.llm.shared import written

#: Hex digits of the shuffle key that make its bucket number: 2**32 values.
_KEY_DIGITS = 8
_KEY_SPAN = float(16**_KEY_DIGITS)


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes plus one; null counts as no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(1)).cast("long")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def shuffle_key(seed: int, *columns: Column) -> Column:
    """A seeded uniform key with the same value in any SQL engine: md5 hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def _offsets(rows: DataFrame, groups: list[str], bucket: str, count: str, offset: str) -> DataFrame:
    """Rows before each bucket, in bucket order within ``groups``; one row a bucket."""
    sizes = rows.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*groups).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    return sizes.select(
        *groups,
        bucket,
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(offset),
        F.sum("__n").over(whole).alias(count),
    )


def assign_shards(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 17,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    bucket_rows: int = 20_000,
) -> DataFrame:
    """Rows with ``size, text_crc32, shard, slot`` (and the id), one per input row.

    Null sources form a stratum of their own; null texts have size 1 and the
    checksum of no bytes. The shuffle is by id and checksum, so rows that repeat an id, or
    have none, fall into different buckets unless their texts are equal too; rows equal
    in all are interchangeable. An empty table gives an empty
    result. Only the columns named are read, so clashing extra columns are harmless.
    """
    keyed = docs.select(
        F.col(id_column).alias("doc_id"),
        F.col(source_column).alias("__source"),
        utf8_size(F.col(text_column)).alias("size"),
        text_crc32(F.col(text_column)).alias("text_crc32"),
        shuffle_key(seed, F.col(id_column), text_crc32(F.col(text_column))).alias("__key"),
    )
    table = written(keyed, "shard-keys")
    rows = table.count()
    buckets = max(1, -(-rows // bucket_rows))

    uniform = F.conv(F.substring("__key", 1, _KEY_DIGITS), 16, 10).cast("double") / F.lit(_KEY_SPAN)
    first = table.withColumn("__b1", F.floor(uniform * F.lit(buckets)).cast("long"))
    # The source is a grouping key that may be null: compare it null-safely.
    off1 = _offsets(first, ["__source"], "__b1", "__rows", "__off1").select(
        F.col("__source").alias("__s"), F.col("__b1").alias("__b"), "__rows", "__off1"
    )
    inner = W.partitionBy("__source", "__b1").orderBy("__key", "doc_id", "text_crc32", "size")
    ranked = (
        first.withColumn("__in", F.row_number().over(inner))
        .join(off1, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__b1") == F.col("__b")))
        .withColumn("__f", (2 * (F.col("__off1") + F.col("__in")) - 1) / (2.0 * F.col("__rows")))
        .select("doc_id", "size", "text_crc32", "__source", "__key", "__f")
    )
    second = ranked.withColumn("__b2", F.floor(F.col("__f") * F.lit(buckets)).cast("long"))
    second = written(second, "shard-ranks")
    off2 = _offsets(second, [], "__b2", "__all", "__off2").select(F.col("__b2").alias("__b"), "__off2")
    order = W.partitionBy("__b2").orderBy(
        "__f", F.col("__source").asc_nulls_last(), "__key", "doc_id", "text_crc32", "size"
    )
    position = second.withColumn("__in", F.row_number().over(order)).join(off2, F.col("__b2") == F.col("__b"))
    at = F.col("__off2") + F.col("__in") - 1
    shard = F.floor(at * F.lit(shards) / F.lit(max(rows, 1))).cast("long")
    # The first position p of shard s is the least with floor(p * shards / rows) = s.
    start = F.floor((F.col("__shard") * F.lit(rows) + F.lit(shards - 1)) / F.lit(shards)).cast("long")
    return (
        position.withColumn("__at", at)
        .withColumn("__shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.col("__shard").cast("int").alias("shard"),
            (F.col("__at") - start).cast("long").alias("slot"),
        )
    )


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
