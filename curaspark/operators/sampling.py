"""Reproducible samples: the rows with the smallest hash keys, exactly as many as a quota says.

The key is the digest of a seed and the row's id, so a sample doesn't depend on partitioning or order. Keys are
counted by cell and their first characters; only the bucket in which a quota ends is ranked, so a cell may hold
any share of the rows without being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 3


def hash_key(id_col: str, seed: int = 42) -> Column:
    """Digest that orders rows; a NULL id counts as ''."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def take_quota(df: DataFrame, cell: list[str], quota: str, id_col: str, seed: int = 42) -> DataFrame:
    """Of each cell as many rows as its ``quota`` column says, those with the smallest keys; ties by id.

    ``quota`` must be constant within a cell; NULL takes none. Columns stay as they are.
    """
    columns = df.columns
    keyed = df.withColumn("__key", hash_key(id_col, seed)).withColumn("__bucket", F.substring("__key", 1, PREFIX))
    counts = keyed.groupBy(*cell, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.first(quota).alias("__most"))
    earlier = Window.partitionBy(*cell).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most cells x 16^PREFIX rows
    reached = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).where("__before < __most")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*cell, "__bucket"]]
    found = keyed.alias("k").join(reached.alias("r"), same).select("k.*", "r.__n", "r.__before", "r.__most")
    whole = found.where("__before + __n <= __most")
    within = Window.partitionBy(*cell, "__bucket").orderBy("__key", id_col)
    part = found.where("__before + __n > __most").withColumn("__rank", F.row_number().over(within)).where("__before + __rank <= __most")
    return whole.select(columns).unionAll(part.select(columns))


def with_cell_counts(df: DataFrame, group: Column, positive: Column) -> DataFrame:
    """Adds ``grp``, ``hate`` (NULL is not), and the group's counts ``n_hate`` and ``n_other``."""
    marked = df.withColumn("grp", F.coalesce(group, F.lit("unknown"))).withColumn("hate", F.coalesce(positive, F.lit(False)))
    counts = marked.groupBy("grp").agg(F.count_if("hate").alias("n_hate"), F.count_if(~F.col("hate")).alias("n_other"))
    return marked.join(counts, "grp")


def balanced_sample(df: DataFrame, group: Column, positive: Column, id_col: str, cap: int = 1000, strict: bool = False, seed: int = 42) -> DataFrame:
    """Per group equally many rows of both classes: as many as there are positive ones, ``cap`` at most; with ``split_label``.

    If a group has fewer others than that, ``strict`` raises, otherwise both classes shrink to them.
    """
    counted = with_cell_counts(df, group, positive)
    if strict:
        short = counted.where(F.col("n_other") < F.least("n_hate", F.lit(cap))).select("grp").distinct().limit(5).collect()
        if short:
            raise ValueError("too few other rows in " + ", ".join(r["grp"] for r in short))
    each = F.least("n_hate", F.lit(cap), "n_other")
    taken = take_quota(counted.withColumn("__each", each), ["grp", "hate"], "__each", id_col, seed)
    return taken.withColumn("split_label", F.col("hate").cast("int")).drop("__each", "n_hate", "n_other")


def balanced_counts(df: DataFrame, group: Column, positive: Column, cap: int = 1000) -> DataFrame:
    """``grp, n_hate, n_other, taken, short``: by group, whether it has fewer than ``cap`` positive rows."""
    grouped = df.groupBy(F.coalesce(group, F.lit("unknown")).alias("grp"))
    counts = grouped.agg(F.count_if(F.coalesce(positive, F.lit(False))).alias("n_hate"), F.count_if(~F.coalesce(positive, F.lit(False))).alias("n_other"))
    return counts.withColumn("taken", F.least("n_hate", "n_other", F.lit(cap))).withColumn("short", F.col("n_hate") < cap)


def balanced_totals(counts: DataFrame) -> DataFrame:
    """The counts by group and their totals, in the group ``TOTAL``."""
    return counts.rollup("grp").agg(F.sum("n_hate").alias("n_hate"), F.sum("n_other").alias("n_other"), F.sum("taken").alias("taken")).withColumn(
        "grp", F.coalesce("grp", F.lit("TOTAL"))
    )


def balanced_downsample(df: DataFrame, label: str, id_col: str, most: int, seed: int = 42) -> DataFrame:
    """All rows if there are at most ``most``, else half of that of each class (label 1 or not), or what it has."""
    total = df.agg(F.count(F.lit(1)).alias("__total"))
    positive = F.coalesce(F.col(label) == 1, F.lit(False))
    quota = F.when(F.lit(total.first()[0]) > most, F.lit(most // 2)).otherwise(F.lit(2**62))
    marked = df.withColumn("__class", positive).withColumn("__quota", quota)
    return take_quota(marked, ["__class"], "__quota", id_col, seed).drop("__class", "__quota")


def stratified_split(df: DataFrame, label: str, id_col: str, one_in: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``split``: of each label one row in ``one_in``, rounded up, is ``test``; a NULL label is a label."""
    counts = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) / one_in).cast("long").alias("__quota"))
    keyed = df.alias("d").join(counts.alias("c"), F.col(f"d.{label}").eqNullSafe(F.col(f"c.{label}"))).select("d.*", "c.__quota")
    test = take_quota(keyed, [label], "__quota", id_col, seed).select(F.col(id_col).alias("__test"))
    return df.join(test, F.col(id_col).eqNullSafe(F.col("__test")), "left").withColumn("split", F.when(F.col("__test").isNotNull(), "test").otherwise("train")).drop("__test")


def random_sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, or all; each partition first keeps only its own smallest keys."""
    return df.withColumn("__key", hash_key(id_col, seed)).orderBy("__key", id_col).limit(n).drop("__key")


def hash_order(df: DataFrame, id_col: str, seed: int = 42) -> DataFrame:
    """All rows in the order of their keys."""
    return df.orderBy(hash_key(id_col, seed), id_col)
