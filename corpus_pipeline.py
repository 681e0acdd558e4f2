"""The corpus pipeline: five operators in a row over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on every row its predecessor kept;
its decisions take effect in the rows it returns. All but the last return the columns of
the documents, whatever further ones there are, with every value as it was. Rows with a null
id, repeated rows and repeated ids are rows like any other; null and empty texts are clean, in
no group of copies, without hits and of size 0; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewarden.llm.decontamination import remove_contaminated
from lakewarden.llm.minhash import one_of_each_group
from lakewarden.llm.mixing import mixed
from lakewarden.llm.shared import absent, fresh_path, ship
from lakewarden.llm.sharding import assign_shards
from lakewarden.llm.toxicity import score_toxicity, train

#: The scores of stage 1 are learned from labels; no SQL expresses them.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject (score under 0.5)."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    score = absent(docs, "__score")
    scored = score_toxicity(docs, train(docs, labels), score_column=score)
    return scored.where(F.col(score) < 0.5).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8): that of the smallest id."""
    ship(spark)
    return one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    ship(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them (0 to 3 times)."""
    ship(spark)
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it."""
    ship(spark)
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
