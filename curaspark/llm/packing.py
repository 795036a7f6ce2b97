"""Filling containers of fixed capacity with items of varying length (problem 8).

*Length-histogram planning*: best-fit decreasing runs over the counts of each length, not over documents.
The histogram has at most ``capacity + 1`` entries, so the plan is made on the driver whatever the number
of documents; equal containers are kept as one group with a count. Documents then take the planned slots
by joining on their rank within their length.

Skew: the rank is taken within (length, shard) with as many shards as the commonest length needs, and
shard offsets come from the counts, so no length is ever ranked in one task.

Defined results: an item longer than the capacity becomes full pieces and one rest; every other item is
one piece 0; NULL or empty texts have length 0 and also get a container; an empty table gives no rows.
Items are identified by ``id_col``, which must be unique.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curaspark.storage import materialize

SHARD_ROWS = 200_000

SLOTS = T.StructType(
    [
        T.StructField("length", T.IntegerType(), False),
        T.StructField("rank_from", T.LongType(), False),
        T.StructField("rank_to", T.LongType(), False),
        T.StructField("first_container", T.LongType(), False),
        T.StructField("per_container", T.LongType(), False),
    ]
)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, first_container, per_container) of a best-fit decreasing packing.

    Ranks ``rank_from <= r < rank_to`` of a length go to container
    ``first_container + (r - rank_from) // per_container``. Containers that look alike are one group
    (first id, count) under their free space, so the work depends on the lengths, not on the documents.
    """
    groups: dict[int, list[tuple[int, int]]] = {}
    free_spaces: list[int] = []
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(free: int, first: int, count: int) -> None:
        if free not in groups:
            groups[free] = []
            insort(free_spaces, free)
        groups[free].append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(free_spaces, length)
            if at < len(free_spaces):
                free = free_spaces[at]
                first, count = groups[free].pop()
                if not groups[free]:
                    del groups[free], free_spaces[at]
            else:
                fit = capacity // length
                free, first, count = capacity, opened, -(-left // fit)
                opened += count
            each = min(free // length, left)
            whole = min(count, left // each)
            slots.append((length, rank, rank + whole * each, first, each))
            put(free - each * length, first, whole)
            rank, left = rank + whole * each, left - whole * each
            if whole < count:
                put(free, first + whole, count - whole)
    if histogram.get(0):
        slots.append((0, 0, histogram[0], 0, histogram[0]))
    return slots


def pack(lengths: DataFrame, capacity: int, id_col: str = "doc_id", length_col: str = "n_tokens") -> DataFrame:
    """``id_col``, ``piece int``, ``container long`` and ``length int`` of every piece."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = lengths.sparkSession
    n = F.col(length_col)
    pieces = F.greatest(F.lit(1), F.ceil(n / F.lit(capacity)).cast("int"))
    items = (
        lengths.select(F.col(id_col), n)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        .select(
            F.col(id_col),
            "piece",
            F.when(F.col("piece") < pieces - 1, F.lit(capacity)).otherwise(n - (pieces - 1) * capacity).cast("int").alias("length"),
        )
    )
    total = F.coalesce(F.max("n"), F.lit(0))
    counted = items.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    shards = max(1, -(-counted.agg(total).first()[0] // SHARD_ROWS))
    items = items.withColumn("shard", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(shards)).cast("int"))
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # one row a length, so at most capacity + 1
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offset_df = (
        items.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n")).select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    slot_df = spark.createDataFrame(plan(histogram, capacity), SLOTS)
    within = Window.partitionBy("length", "shard").orderBy(id_col, "piece")
    ranked = (
        items.withColumn("rank", F.row_number().over(within) - 1)
        .join(offset_df, ["length", "shard"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
    )
    fits = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    # the plan is bounded by the capacity: a few slots a length
    return (
        ranked.join(F.broadcast(slot_df.withColumnRenamed("length", "slot_length")), (F.col("length") == F.col("slot_length")) & fits)
        .withColumn("container", F.col("first_container") + F.expr("(rank - rank_from) div per_container"))
        .select(F.col(id_col), "piece", "container", "length")
    )


def pack_documents(documents: DataFrame, capacity: int, **tokenizer: str) -> DataFrame:
    """Pack texts by their lengths in tokens; the texts are encoded once and only the lengths are kept."""
    from curaspark.llm.bpe import token_counts

    lengths = materialize(token_counts(documents, "doc_id", "text", **tokenizer), "token-counts")
    return pack(lengths, capacity)
