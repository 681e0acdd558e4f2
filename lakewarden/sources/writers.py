"""Sinks: audit lines, the object mirror, reports, and their streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewarden.operators.audit import put_objects
from lakewarden.operators.staged import staged


def audit_line(event: str, fields: dict[str, Column]) -> Column:
    """A compact JSON line with sorted keys; null fields are left out."""
    named = {"event": F.lit(event), **fields}
    return F.to_json(F.struct(*[named[k].alias(k) for k in sorted(named)]))


def append_lines(lines: DataFrame, path: str) -> None:
    """Add lines (one string column) to a text log folder."""
    lines.write.mode("append").text(path)


def put_mirror(incoming: DataFrame, path: str) -> DataFrame:
    """Write objects ``key, body`` that are new and return every outcome; conflicts write nothing.

    Repeating a put changes nothing, so a batch that is run again is harmless. The outcomes
    are those before the write, whenever they are read.
    """
    spark = incoming.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    held = spark.read.parquet(path) if exists else spark.createDataFrame([], incoming.schema)
    outcomes = staged(put_objects(held, incoming), "mirror-puts")
    outcomes.where("write").select("key", "body").write.mode("append").parquet(path)
    return outcomes


def mirror_key(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.lpad(number.cast("string"), 20, "0"))


def keyring_key(body: Column) -> Column:
    return F.concat(F.lit("keyring-state/"), F.sha2(body, 256))


def each_batch_once(write: Callable[[DataFrame, str], None], path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes batch n under its own folder, so a retry replaces it."""

    def run(batch: DataFrame, number: int) -> None:
        write(batch, f"{path}/batch={number}")

    return run


def report_lines(report: DataFrame) -> DataFrame:
    """A console table's lines: the columns' names, then each row, fields by tabs and absent ones empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in report.columns]
    return report.select(F.concat_ws("\t", *cells).alias("line"))


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def badge(levels: DataFrame) -> DataFrame:
    """``label, color`` for the highest level reached (``level, reached``, names in order)."""
    best = levels.agg(F.max(F.when(F.col("reached"), F.col("level"))).alias("label"))
    return best.select(F.coalesce("label", F.lit("none")).alias("label"), F.when(F.col("label").isNull(), "red").otherwise("brightgreen").alias("color"))
