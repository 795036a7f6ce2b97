"""Labels that arrive as files: each micro-batch adds its verdicts, votes are taken when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from curaspark.operators.votes import majority
from curaspark.sources.sinks import StagedResults

VERDICTS = T.StructType(
    [T.StructField("original_idx", T.LongType()), T.StructField("judge", T.StringType()), T.StructField("is_hate", T.BooleanType()), T.StructField("raw", T.StringType())]
)


def ingest_labels(spark: SparkSession, incoming: str, results: str, checkpoint: str) -> StreamingQuery:
    """Read verdict files as they appear and store their verdicts; ends when all present files are read.

    Verdicts are kept, not votes, so those of an item may come in several batches; ``read_votes`` votes. A batch that
    is run again after a failure replaces its own output.
    """
    store = StagedResults(spark, results, "original_idx")

    def add(batch: DataFrame, number: int) -> None:
        store.append(batch, number)

    stream = spark.readStream.schema(VERDICTS).json(incoming)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_verdicts(spark: SparkSession, results: str) -> DataFrame | None:
    """The first verdict of each item and judge, as judges don't judge again; None before the first batch."""
    rows = StagedResults(spark, results, "original_idx").every()
    if rows is None:
        return None
    row = F.struct("__batch", "is_hate", "raw")
    return rows.groupBy("original_idx", "judge").agg(F.min(row).alias("m")).select("original_idx", "judge", "m.is_hate", "m.raw")


def read_votes(spark: SparkSession, results: str) -> DataFrame | None:
    """Votes over all verdicts stored so far; None before the first batch."""
    verdicts = read_verdicts(spark, results)
    return None if verdicts is None else majority(verdicts)
