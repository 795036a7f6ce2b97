"""Functions of dense vectors held in array columns; computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curaspark.functions.text import let


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(vector), F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(vector: Column) -> Column:
    """At length 1; a zero vector stays."""
    norm = l2_norm(vector)
    return let(F.when(norm == 0, 1.0).otherwise(norm), lambda n: F.transform(as_double(vector), lambda x: x / n))


def argmax(values: Column) -> Column:
    """Position (from 0) of the largest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("long")
