"""Majority votes over judges' verdicts, in long form ``original_idx, judge, is_hate, raw``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions.text import ustrip

THRESHOLD = 4
MIN_TEXT = 10


def to_long(wide: DataFrame, judges: list[str], key: str = "original_idx") -> DataFrame:
    """Columns ``judge_<name>`` and ``judge_<name>_raw`` as rows; a narrow map."""
    rows = F.array(*[F.struct(F.lit(j).alias("judge"), F.col(f"judge_{j}").alias("is_hate"), F.col(f"judge_{j}_raw").alias("raw")) for j in judges])
    return wide.select(key, F.inline(rows))


def to_wide(long: DataFrame, judges: list[str], key: str = "original_idx") -> DataFrame:
    """The verdicts as columns; a judge's later row of an item is ignored if there are several."""
    cells = []
    for j in judges:
        own = F.when(F.col("judge") == j, F.struct("is_hate", "raw"))
        cells += [F.max(own).alias(f"__{j}")]
    flat = [x for j in judges for x in (F.col(f"__{j}.is_hate").alias(f"judge_{j}"), F.col(f"__{j}.raw").alias(f"judge_{j}_raw"))]
    return long.groupBy(key).agg(*cells).select(key, *flat)


def majority(verdicts: DataFrame, key: str = "original_idx", threshold: int = THRESHOLD) -> DataFrame:
    """``vote_label, hate_votes, total_votes`` by item. The threshold is absolute: abstentions don't lower it; without a verdict the label is NULL."""
    votes = verdicts.groupBy(key).agg(F.count_if("is_hate").alias("hate_votes"), F.count("is_hate").alias("total_votes"))
    return votes.select(key, F.when(F.col("total_votes") > 0, F.col("hate_votes") >= threshold).alias("vote_label"), "hate_votes", "total_votes")


def long_enough(text: F.Column) -> F.Column:
    """Texts that judges get to see; NULL counts as ''."""
    return F.coalesce(F.length(ustrip(text)), F.lit(0)) >= MIN_TEXT


def label_texts(texts: DataFrame, verdicts: DataFrame, key: str = "original_idx") -> DataFrame:
    """Texts with their votes; too short ones have no label and no counts, whatever verdicts there are."""
    votes = majority(verdicts, key)
    seen = F.col("__seen")
    joined = texts.withColumn("__seen", long_enough(F.col("text"))).join(votes, key, "left")
    return joined.select(*texts.columns, *[F.when(seen, F.col(c)).alias(c) for c in ("vote_label", "hate_votes", "total_votes")])


def add_judge(items: DataFrame, verdicts: DataFrame, more: DataFrame, key: str = "original_idx") -> DataFrame:
    """Votes of all items after another judge's verdicts of items that it hasn't judged yet; items without verdicts get 0 votes."""
    fresh = more.join(verdicts.select(key, "judge").distinct(), [key, "judge"], "left_anti")
    votes = majority(verdicts.unionByName(fresh), key)
    return items.select(key).distinct().join(votes, key, "left").select(key, "vote_label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("hate_votes", "total_votes")])


def label_distribution(votes: DataFrame) -> DataFrame:
    """Counts and percentages of hate and other labels over all rows, NULL labels included in the total."""
    total, hate, other = F.count(F.lit(1)), F.count_if(F.col("vote_label")), F.count_if(~F.col("vote_label"))
    share = lambda n: F.bround(F.try_divide(n * F.lit(100.0), total), 1)
    return votes.agg(total.alias("total"), hate.alias("hate"), other.alias("non_hate"), share(hate).alias("hate_pct"), share(other).alias("non_hate_pct"))


def judge_rates(verdicts: DataFrame) -> DataFrame:
    """By judge: rows, verdicts, hate verdicts and their percentage of all rows."""
    total, hate = F.count(F.lit(1)), F.count_if(F.col("is_hate"))
    return verdicts.groupBy("judge").agg(total.alias("n"), F.count("is_hate").alias("verdicts"), hate.alias("hate"), F.bround(hate * F.lit(100.0) / total, 1).alias("hate_pct"))
