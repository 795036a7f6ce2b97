"""Exact cosine neighbours and greedy de-duplication of vectors.

Edges: rows are placed with the nearest of a bounded number of pivot vectors. Angles obey the triangle inequality, so
two pivots' rows can only meet the threshold if the pivots' angle is at most both radii plus the threshold's angle; all
other pairs of clusters are skipped, without losing an edge. Clusters are cut into blocks of ``BLOCK`` rows, pairs of
blocks are separate tasks, and a task multiplies two small matrices.

Greedy de-duplication keeps a row unless an earlier kept one is too similar: the first maximal independent set in the
order of the ids. Rows without earlier neighbours are kept, their later neighbours removed, until no edge is left. Once
the edges fit ``DRIVER_EDGES`` the rest runs in one pass, so a long chain can't force a round per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions.vectors import l2_normalize
from curaspark.session import ship
from curaspark.storage import materialize, release

PIVOTS = 1024
BLOCK = 2000
DRIVER_EDGES = 2_000_000
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _pivots(unit: DataFrame) -> np.ndarray:
    """One pivot for each full block of rows, ``PIVOTS`` at most."""
    n = min(PIVOTS, -(-unit.count() // BLOCK))
    rows = unit.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def cosine_edges(df: DataFrame, id_col: str, vector_col: str, threshold: float) -> DataFrame:
    """``a, b, cos``: pairs with ``a < b`` whose cosine is above the threshold, strictly. NULL vectors have none, zero vectors neither."""
    spark = df.sparkSession
    ship(spark)
    unit = materialize(df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), l2_normalize(F.col(vector_col)).alias("v")), "unit-vectors")
    pivots = _pivots(unit)
    if not len(pivots):
        return spark.createDataFrame([], "a long, b long, cos double")
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cos = _matrix(batch.column(1)) @ shared.value.T
            at = cos.argmax(1)
            angle = np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at.astype(np.int32)), pa.array(angle)], names=["id", "v", "c", "angle"])

    placed = materialize(unit.mapInArrow(place, "id long, v array<double>, c int, angle double"), "placed-vectors")
    clusters = {r["c"]: (r["n"], r["radius"]) for r in placed.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()}  # PIVOTS rows
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    at = np.array(sorted(clusters))
    blocks, radius = np.array([-(-clusters[c][0] // BLOCK) for c in at]), np.array([clusters[c][1] for c in at])
    apart = np.arccos(np.clip(pivots[at] @ pivots[at].T, -1, 1))
    near = np.triu(apart <= radius[:, None] + radius[None, :] + reach + SLACK) | np.eye(len(at), dtype=bool)
    pairs = [(int(at[i]), int(at[j]), int(blocks[i]), int(blocks[j])) for i, j in zip(*np.nonzero(near))]
    meet = spark.createDataFrame(pairs, "i int, j int, n_i int, n_j int")
    # a row goes to each block pair of its block: as first with every block of j, as second with every block of i
    own = placed.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(2**31)))
    left = own.join(F.broadcast(meet), F.col("c") == F.col("i")).withColumn("x", (F.col("h") % F.col("n_i")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_j") - 1)))
    left = left.where((F.col("i") < F.col("j")) | (F.col("x") <= F.col("y"))).select("i", "j", "x", "y", F.lit(0).alias("side"), "id", "v")
    right = own.join(F.broadcast(meet), F.col("c") == F.col("j")).withColumn("y", (F.col("h") % F.col("n_j")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1)))
    right = right.where((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))).select("i", "j", "x", "y", F.lit(1).alias("side"), "id", "v")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        side, ids = table.column("side").to_numpy(), table.column("id").to_numpy()
        vectors = _matrix(table.column("v").combine_chunks())
        first = side == 0
        a, x = ids[first], vectors[first]
        b, y = (ids[~first], vectors[~first]) if (~first).any() else (a, x)
        for at in range(0, len(a), 500):
            cos = x[at : at + 500] @ y.T
            p, q = np.nonzero(cos > threshold)
            ia, ib = a[at : at + 500][p], b[q]
            kept = (ia < ib) if b is a else (ia != ib)
            value = cos[p, q][kept]
            ia, ib = ia[kept], ib[kept]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia, ib)), pa.array(np.maximum(ia, ib)), pa.array(value)], names=["a", "b", "cos"])

    return left.unionAll(right).groupBy("i", "j", "x", "y").applyInArrow(_on_table(multiply), "a long, b long, cos double")


def _on_table(run):
    def apply(table: pa.Table) -> pa.Table:
        out = list(run(iter(table.to_batches())))
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64())])
        return pa.Table.from_batches(out, schema=schema)

    return apply


def first_independent(edges: DataFrame) -> DataFrame:
    """``id`` of the rows removed by the greedy rule; ``edges``: ``a < b``."""
    spark = edges.sparkSession
    left = materialize(edges.select("a", "b"), "edges")
    removed = None
    while left.count() > DRIVER_EDGES:
        kept = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        gone = materialize(left.join(kept.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "removed")
        removed = gone if removed is None else removed.unionAll(gone)
        before = left
        left = materialize(left.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").join(kept.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b"), "edges")
        release(before)
    rest = left.orderBy("a", "b").toArrow()  # DRIVER_EDGES rows at most
    out: set[int] = set()
    for a, b in zip(rest.column("a").to_pylist(), rest.column("b").to_pylist()):
        if a not in out:
            out.add(b)
    local = spark.createDataFrame(pa.table({"id": pa.array(sorted(out), type=pa.int64())}))
    return local if removed is None else removed.unionAll(local)


def greedy_dedup(df: DataFrame, id_col: str, vector_col: str, threshold: float = 0.9) -> DataFrame:
    """The rows that the greedy rule keeps, in any order; rows without a vector are kept."""
    gone = first_independent(cosine_edges(df, id_col, vector_col, threshold))
    return df.join(gone.withColumnRenamed("id", "__gone"), F.col(id_col) == F.col("__gone"), "left_anti")


def dedup_ratio(df: DataFrame, kept: DataFrame) -> DataFrame:
    """``n, kept, removed, removed_pct``."""
    both = df.agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("kept")).unionAll(kept.agg(F.lit(0).cast("long").alias("n"), F.count(F.lit(1)).alias("kept")))
    total = both.agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    removed = F.col("n") - F.col("kept")
    return total.select("n", "kept", removed.alias("removed"), F.bround(F.try_divide(removed * F.lit(100.0), F.col("n")), 1).alias("removed_pct"))
