"""Writers: JSON lines in order, checkpoints by stages, sidecar statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark import storage
from curaspark.operators.relational import last_by


def write_ranked_jsonl(df: DataFrame, path: str, rank: str = "rank") -> None:
    """JSON lines in the order of ``rank``, which stays a column; NULL fields are written."""
    df.orderBy(rank).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines added to a folder, in any order."""
    df.write.mode("append").json(path)


def overwrite_in_place(df: DataFrame, path: str) -> None:
    """Replace a Parquet folder that ``df`` may itself read: written beside, then swapped."""
    spark = df.sparkSession
    fresh = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    old = f"{fresh}.old"
    if storage.exists(spark, path):
        storage.move(spark, path, old)
    storage.move(spark, fresh, path)
    storage.remove(spark, old)


class StagedResults:
    """Results that come in batches: each is appended as it is; reading gives the last version of each key.

    A crash loses at most the batch being written, and nothing is rewritten.
    """

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def append(self, batch: DataFrame, number: int) -> None:
        """Add a batch; writing the same number again replaces it, so a repeated batch does no harm."""
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def read(self) -> DataFrame | None:
        """The last version of each key; None before the first batch."""
        rows = self.every()
        return None if rows is None else last_by(rows, self.key, ["__batch"]).drop("__batch")

    def every(self) -> DataFrame | None:
        """All rows of all batches, with ``__batch``."""
        if not storage.exists(self.spark, self.path):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/batch=*")

    def compact(self, target: str) -> None:
        """One sorted table of the last versions."""
        self.read().orderBy(self.key).write.mode("overwrite").parquet(target)


def write_metrics(metrics: DataFrame, path: str, by: str = "dataset") -> None:
    """Metrics as one JSON list, an object a data set in the order of their names; a row a data set reaches the driver."""
    rows = F.sort_array(F.collect_list(F.struct(by, *[c for c in metrics.columns if c != by])))
    listed = metrics.agg(F.to_json(rows, {"ignoreNullFields": "false"}).alias("value"))
    listed.coalesce(1).write.mode("overwrite").text(path)


def write_embeddings(df: DataFrame, path: str, id_col: str, vector_col: str) -> None:
    """A cache of vectors that ``readers.read_embeddings`` reads: ``ord, embedding``."""
    df.select(F.col(id_col).cast("long").alias("ord"), F.col(vector_col).cast("array<double>").alias("embedding")).write.mode("overwrite").parquet(path)


def write_sidecar(row: DataFrame, path: str) -> None:
    """A small table of statistics as one JSON file."""
    row.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
