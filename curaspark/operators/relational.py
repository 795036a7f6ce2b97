"""Ids, grids, unions and joins that keep track of order by an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.functions.text import key_or_unknown
from curaspark.sources.catalog import GROUPS, SENTIMENTS
from curaspark.storage import materialize


def dense_ids(df: DataFrame, order: list[str], name: str = "id", first: int = 0) -> DataFrame:
    """Consecutive ids in the given order, without ranking all rows in one task.

    Rows are range-partitioned by ``order``, counted by partition, and numbered within it from the partition's offset.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy("__part").orderBy(*order)
    numbered = placed.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(offsets), "__part")
    return numbered.withColumn(name, F.col("__rank") + F.col("__offset") + (first - 1)).drop("__part", "__rank", "__offset")


def union_with_ids(parts: list[tuple[str, DataFrame]], ord_col: str, text_col: str) -> DataFrame:
    """``id, persona, source``: the parts one after the other, each in its own order, with dense ids."""
    labelled = [p.select(F.lit(k).alias("__rank_of"), F.col(ord_col).alias("__ord"), F.col(text_col).alias("persona"), F.lit(source).alias("source")) for k, (source, p) in enumerate(parts)]
    whole = labelled[0]
    for more in labelled[1:]:
        whole = whole.unionByName(more)
    return dense_ids(whole, ["__rank_of", "__ord", "persona"]).select("id", "persona", "source")


def task_grid(personas: DataFrame, ord_col: str = "id", text_col: str = "persona") -> DataFrame:
    """A task for each persona, group and sentiment; ``task_id`` is its place in that order. A narrow map, no join."""
    n = len(GROUPS) * len(SENTIMENTS)
    grid = personas.select(F.col(ord_col).alias("ord"), F.col(text_col).alias("persona"), F.posexplode(F.array(*map(F.lit, GROUPS))).alias("g", "group"))
    grid = grid.select("*", F.posexplode(F.array(*map(F.lit, SENTIMENTS))).alias("s", "sentiment"))
    task = F.col("ord") * n + F.col("g") * len(SENTIMENTS) + F.col("s")
    return grid.select(task.cast("long").alias("task_id"), key_or_unknown(F.col("ord")).alias("persona_id"), "persona", "group", "sentiment")


def not_refused(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("is_refused"), F.lit(False)))


def index_not_refused(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows that aren't refused with their dense ``original_idx`` in the given order."""
    return dense_ids(not_refused(df), order, "original_idx")


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not done yet. NULL keys are never done."""
    return todo.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def last_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that comes last; partial maxima are taken before rows move."""
    order_by = F.struct(*order)
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order_by).alias("__row")).select(key, "__row.*")


def resume(done: DataFrame, fresh: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What was done, the last version of each key, and the fresh rows of keys not done."""
    kept = last_by(done, key, order)
    return kept.unionByName(pending(fresh, kept, key).select(kept.columns))


def missing_judge(verdicts: DataFrame, items: DataFrame, judge: str, key: str = "original_idx") -> DataFrame:
    """Items without any row of this judge; a stored NULL verdict is a row."""
    return items.join(verdicts.where(F.col("judge") == judge).select(key).distinct(), key, "left_anti")


def prefix(df: DataFrame, ord_col: str, n: int | None) -> DataFrame:
    """The first ``n`` rows by an ordinal that counts from 0; None takes all."""
    return df if n is None else df.where(F.col(ord_col) < n)


def label_or_split(df: DataFrame) -> DataFrame:
    """Adds ``label`` from ``split_label`` where only the latter exists."""
    return df.withColumn("label", F.col("split_label")) if "label" not in df.columns and "split_label" in df.columns else df
