"""Where operators keep what more than one job reads.

A multi-job operator cuts its lineage with a Parquet table in the folder that the
session names in ``spark.checkpoint.dir``. Every executor sees that folder, so a
lost executor costs a reread, never a result. Only when the setting is absent
(plain local tests) is a folder chosen here.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Bytes of an Arrow batch between the JVM and Python.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application, and bound this session's Arrow batches."""
    # Large batches of long texts would be held several times over, in the JVM's direct memory and in Python.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="lakewarden-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        path = "file://" + tempfile.mkdtemp(prefix="lakewarden-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier call has returned."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table from ``written`` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def quoted(name: str) -> str:
    """A column name as it stands in an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def absent(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def place_of(df: DataFrame, name: str) -> int:
    """The place of a column, found as Spark finds it: in any letter case."""
    return next(i for i, c in enumerate(df.columns) if c.lower() == name.lower())


#: Rows that are sliced off an Arrow batch at once, so that a task's arrays follow these and not the batch.
SLICE_ROWS = 512


def appended(docs: DataFrame, read: list[str], new: list[StructField], make: Callable[[], Callable], give_back: bool = True) -> DataFrame:
    """``docs`` with columns that Python computes from the columns ``read``, all others passed on as Arrow.

    ``make`` runs once a task and returns a function that takes the values of ``read`` (texts as
    UTF-8 ``bytes``, or None) and returns one list or array for each of ``new``. Nothing else is
    looked at, so no other column's type, null or large integer can change on the way. Without
    ``give_back`` the columns ``read`` are not in the result.
    """
    places = [place_of(docs, name) for name in read]
    stay = [i for i in range(len(docs.columns)) if give_back or i not in places]
    schema = StructType([*[docs.schema.fields[i] for i in stay], *new])
    kinds = [to_arrow_type(f.dataType) for f in new]
    # Names stay outside: they may hold dots, which Spark would take for nested fields.
    plain = [f"c{i}" for i in range(len(schema))]
    inner = StructType([StructField(n, f.dataType, f.nullable) for n, f in zip(plain, schema, strict=True)])

    def run(batches):
        compute = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                found = compute(*[part.column(i).cast(pa.large_binary()).to_pylist() for i in places])
                arrays = [pa.array(v, kind) for v, kind in zip(found, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in stay], *arrays], names=plain)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(run, inner).toDF(*schema.names)


def row_key(*columns: Column) -> Column:
    """A 128-bit key of a row's values, nulls told from empty texts; the same in any run."""
    parts = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.md5(F.concat(*parts))


def one_row_each(docs: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is in ``wanted`` (unique ``key``, its number of rows ``n``, more), one row for each key.

    Rows that share a key are alike: the few keys that repeat have their rows reduced map-side.
    """
    kept = docs.join(wanted.where("n = 1").drop("n"), key)
    again = wanted.where("n > 1").drop("n")
    if again.isEmpty():
        return kept
    return kept.unionByName(docs.join(again, key).dropDuplicates([key]))
