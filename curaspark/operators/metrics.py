"""Benchmarks in one form, and metrics of binary classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curaspark.functions.text import ustrip


def valid_text(text: Column) -> Column:
    """Not NULL and not blank."""
    return F.coalesce(F.length(ustrip(text)) > 0, F.lit(False))


def non_empty(text: Column) -> Column:
    """Not NULL and not ''; blanks pass."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def without_value(column: Column, value: str) -> Column:
    """Rows with another value or none: NULL passes."""
    return ~column.eqNullSafe(F.lit(value))


def bench_without_offensive(df: DataFrame, dataset: str) -> DataFrame:
    """``dataset, text, label``: all but the label 'offensive', truth as integer."""
    kept = df.where(without_value(F.col("label"), "offensive"))
    return _bench(kept, dataset, F.col("text"), F.col("ground_truth"))


def bench_three_classes(df: DataFrame, dataset: str) -> DataFrame:
    """Class 1 is left out, class 0 is hate; a NULL class is left out too."""
    return _bench(df.where(F.col("class") != 1), dataset, F.col("tweet"), (F.col("class") == 0).cast("int"))


def bench_rated(df: DataFrame, dataset: str) -> DataFrame:
    """A numeric label, NULL left out, cut to an integer."""
    return _bench(df.where(F.col("label").isNotNull()), dataset, F.col("text"), F.col("label"))


def bench_plain(df: DataFrame, dataset: str, label: str) -> DataFrame:
    return _bench(df, dataset, F.col("text"), F.col(label))


def _bench(df: DataFrame, dataset: str, text: Column, label: Column) -> DataFrame:
    return df.select(F.lit(dataset).alias("dataset"), text.alias("text"), label.cast("int").alias("label"))


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred", by: str = "dataset") -> DataFrame:
    """Per dataset the rows with a valid prediction and truth, their positives, and accuracy, F1, precision and recall in percent.

    One pass of counts; what would divide by 0 is 0; ties are rounded to even.
    """
    t, p = F.col(label) == 1, F.col(pred) == 1
    valid = df.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    c = valid.groupBy(by).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(t).alias("n_hate"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(
        by,
        "samples",
        "n_hate",
        F.bround(ratio(tp + F.col("tn"), F.col("samples")), 1).alias("accuracy"),
        F.bround(ratio(2 * tp, 2 * tp + fp + fn), 1).alias("f1"),
        F.bround(ratio(tp, tp + fp), 1).alias("precision"),
        F.bround(ratio(tp, tp + fn), 1).alias("recall"),
    )
