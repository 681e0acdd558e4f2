"""Tables that more than one plan reads, written once to the folder every executor sees.

The folder is the one in ``spark.checkpoint.dir``; a lost executor then costs a reread of
files. Only a session with a local master and no such setting gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(table: DataFrame, name: str) -> DataFrame:
    """``table`` written once and read back: what follows does not compute it again."""
    spark = table.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that every executor sees")
        folder = "file://" + tempfile.mkdtemp(prefix="lakewarden-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)
