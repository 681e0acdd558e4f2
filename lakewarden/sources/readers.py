"""Sources: policies, name lists, annotated sentences, audit logs, checkpoints, event streams."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakewarden.functions.expressions import casefold_de
from lakewarden.operators.policy import Policy, PolicyError, load_policy


def _one_file(spark: SparkSession, path: str) -> tuple[bytes, object]:
    row = spark.read.format("binaryFile").load(path).select("content", "modificationTime").first()
    if row is None:
        raise PolicyError(f"no file at {path}")
    return bytes(row.content), row.modificationTime


def read_policy(spark: SparkSession, path: str, signed: Callable[[bytes], object] | None = None, newer_than: str | None = None) -> Policy:
    """A YAML or JSON policy file (one small file, read on the driver).

    In this order: its signers (``signed`` gets the exact bytes and raises if they do not
    suffice), its content, and, for a signed one, that it takes effect no earlier than the one before.
    """
    import yaml

    body, _ = _one_file(spark, path)
    if signed is not None:
        signed(body)
    policy = load_policy(yaml.safe_load(body), body)
    if signed is not None and newer_than and (policy.effective_from or "") < newer_than:
        raise PolicyError(f"policy of {policy.effective_from} is older than that of {newer_than}")
    return policy


def folder_state(spark: SparkSession, folder: str) -> frozenset[tuple[str, int, int]]:
    """Path, length and time of every file below a folder: two states differ once anything in it has changed."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = top.getFileSystem(context._jsc.hadoopConfiguration()).listFiles(top, True), set()
    while files.hasNext():
        f = files.next()
        found.add((str(f.getPath()), f.getLen(), f.getModificationTime()))
    return frozenset(found)


class PolicyWatch:
    """Reloads a policy when anything in its folder changes, once a change, and keeps the last valid one; the first must be valid."""

    def __init__(self, spark: SparkSession, path: str, signed: Callable[[bytes], object] | None = None):
        self.spark, self.path, self.signed, self.seen, self.fault = spark, path, signed, None, None
        self.policy: Policy | None = None

    def current(self) -> Policy:
        state = folder_state(self.spark, str(PurePosixPath(self.path).parent))
        if state != self.seen:
            self.seen = state
            try:
                before = self.policy.effective_from if self.policy else None
                self.policy, self.fault = read_policy(self.spark, self.path, self.signed, before), None
            except Exception as fault:  # noqa: BLE001  whatever is wrong with the new file, the old policy stays
                if self.policy is None:
                    raise
                self.fault = fault
        return self.policy


def safe_relative(path: str) -> str:
    """A list's path below the policy's folder; absolute paths and parent steps are refused."""
    parts = PurePosixPath(path)
    if parts.is_absolute() or ".." in parts.parts:
        raise PolicyError(f"list path must stay below the policy: {path}")
    return str(parts)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct casefolded ``name``; blank lines and comments are skipped, an empty list is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' and not startswith(v, '#')")
    names = lines.select(casefold_de(F.col("v")).alias("name")).distinct()
    if names.isEmpty():
        raise PolicyError(f"name list is empty: {path}")
    return names


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """A name list in composed Unicode form (NFC), which the JVM functions lack."""

    @F.pandas_udf("string")
    def composed(values):
        return values.map(lambda v: unicodedata.normalize("NFC", v))

    return read_name_list(spark, path).select(composed("name").alias("name")).distinct()


EVAL_SCHEMA = "id string, text string, entities array<struct<start:int,end:int,type:string,value:string,oov:boolean>>, tags array<string>"


def read_eval_sets(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).json(list(paths))


def gold_spans(rows: DataFrame) -> DataFrame:
    """``id, s, e, type, oov`` of annotated rows."""
    x = rows.select("id", F.explode("entities").alias("x"))
    return x.select("id", F.col("x.start").alias("s"), F.col("x.end").alias("e"), F.col("x.type").alias("type"), F.col("x.oov").alias("oov"))


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """``seg, line_no, raw_line``: a segment is a file; places come from the file's own order.

    Each file is one row's worth of text, so its order is certain however files are split
    among tasks; segments (rotated logs) keep files small.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("seg"), "value")
    lines = whole.select("seg", F.posexplode(F.split("value", "\n")).alias("p", "raw_line")).where("trim(raw_line) <> ''")
    place = F.row_number().over(W.partitionBy("seg").orderBy("p"))
    return lines.select("seg", place.cast("long").alias("line_no"), "raw_line")


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """``file, envelope`` in name order; ``readable`` is false for a file that is not JSON."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("envelope"))
    return files.withColumn("readable", F.try_parse_json("envelope").isNotNull()).orderBy("file")


def body_checks(bodies: DataFrame, limit: int, body: str = "body") -> DataFrame:
    """``status``: 413 over the limit (tested before parsing), 400 if not a JSON object, else 200."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return bodies.withColumn(
        "status", F.when(F.octet_length(body) > limit, 413).when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), 200).otherwise(400)
    )


def sse_payload(line: Column) -> Column:
    """``struct<done, json>`` of a ``data:`` line; null for other lines and broken JSON."""
    data = F.trim(F.substr(line, F.lit(6)))
    done = data == "[DONE]"
    ok = line.startswith("data:") & (done | F.try_parse_json(data).isNotNull())
    return F.when(ok, F.struct(done.alias("done"), F.when(~done, data).alias("json")))


def sse_chunks(lines: DataFrame, line: str = "line") -> DataFrame:
    """Chunks ``request_id, line_no, choice, content, finish_reason`` of event-stream lines."""
    rows = lines.withColumn("p", sse_payload(F.col(line))).where("p is not null and not p.done")
    choices = F.from_json(F.col("p.json"), "choices array<struct<index:int,delta:struct<content:string>,finish_reason:string>>")
    rows = rows.select("request_id", "line_no", F.explode(choices["choices"]).alias("c"))
    return rows.select("request_id", "line_no", F.col("c.index").alias("choice"), F.col("c.delta.content").alias("content"), F.col("c.finish_reason").alias("finish_reason"))


def list_versions(spark: SparkSession, path: str) -> DataFrame:
    """A versioned object listing ``key, version_id, body`` kept as a table."""
    return spark.read.parquet(path).select("key", "version_id", "body")
