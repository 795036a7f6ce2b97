"""Farthest-point sampling, plain and weighted by density, and how well a sample fills the space.

Each pick needs one pass over the distances to the pick before. While all vectors together are under ``DRIVER_BYTES``
(checked) the picks run on the driver in array operations; beyond that each pick is one narrow distributed pass that
returns one candidate a partition, and distances so far are written every ``STATE_EVERY`` picks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.functions.vectors import as_double
from curaspark.session import ship
from curaspark.storage import materialize, release

DRIVER_BYTES = 256 << 20
STATE_EVERY = 16
PICKS = "rank int, id long, distance double"


def _points(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), as_double(F.col(vector_col)).alias("v"))


def _fits(points: DataFrame) -> bool:
    total = points.agg(F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("x")).first()["x"]
    return total * 8 <= DRIVER_BYTES


def _local(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = points.orderBy("id").toArrow()
    ids = table.column("id").to_numpy()
    values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, values.reshape(len(ids), -1) if len(ids) else np.zeros((0, 0))


def _to(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


def farthest_points(df: DataFrame, id_col: str, vector_col: str, budget: int, start: int | None = None, driver_bytes: int | None = None) -> DataFrame:
    """``rank, id, distance``: in order of selection, each pick with its distance to those before (NULL for the first).

    Euclidean, on the vectors as they are; ties go to the lowest id; the first pick is ``start``, else the lowest id. A budget
    of all points or more gives all of them in order of id; when only copies of picked points are left it stops early.
    """
    spark = df.sparkSession
    points = _points(df, id_col, vector_col)
    if budget < 1:
        return spark.createDataFrame([], PICKS)
    small = _fits(points) if driver_bytes is None else points.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0] * 8 <= driver_bytes
    return _farthest_local(points, budget, start) if small else _farthest_distributed(points, budget, start)


def _farthest_local(points: DataFrame, budget: int, start: int | None) -> DataFrame:
    ids, x = _local(points)
    spark = points.sparkSession
    if budget >= len(ids):
        return spark.createDataFrame([(k, int(i), None) for k, i in enumerate(ids)], PICKS)
    at = int(np.searchsorted(ids, start)) if start is not None else 0
    rows: list[tuple[int, int, float | None]] = [(0, int(ids[at]), None)]
    least = _to(x, x[at])
    while len(rows) < budget:
        at = int(least.argmax())
        if least[at] <= 0:
            break
        rows.append((len(rows), int(ids[at]), float(least[at])))
        least = np.minimum(least, _to(x, x[at]))
    return spark.createDataFrame(rows, PICKS)


def _farthest_distributed(points: DataFrame, budget: int, start: int | None) -> DataFrame:
    spark = points.sparkSession
    ship(spark)
    state = materialize(points.withColumn("d", F.lit(float("inf"))), "distances")
    if budget >= state.count():
        rows = state.orderBy("id").select("id").collect()  # no more than the budget
        return spark.createDataFrame([(k, r["id"], None) for k, r in enumerate(rows)], PICKS)
    first = (state if start is None else state.where(F.col("id") == start)).agg(F.min_by("v", "id").alias("v"), F.min("id").alias("id")).first()
    rows: list[tuple[int, int, float | None]] = [(0, first["id"], None)]
    recent = [first["v"]]

    def closer(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            picks = np.array(shared.value)
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                d = batch.column(2).to_numpy(zero_copy_only=False).copy()
                for p in picks:
                    d = np.minimum(d, _to(x, p))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["id", "v", "d"])

        return run

    while len(rows) < budget:
        moved = state.mapInArrow(closer(spark.sparkContext.broadcast(recent)), "id long, v array<double>, d double")
        if len(recent) >= STATE_EVERY:
            before, recent = state, []
            state = moved = materialize(moved, "distances")
            release(before)
        best = moved.agg(F.max(F.struct("d", (-F.col("id")).alias("i"))).alias("m"), F.max_by("v", F.struct("d", -F.col("id"))).alias("v")).first()
        if best["m"]["d"] <= 0:
            break
        rows.append((len(rows), -best["m"]["i"], float(best["m"]["d"])))
        recent = [*recent, best["v"]]
    return spark.createDataFrame(rows, PICKS)


def _radius(least: float, picked: int, epsilon: float, knn: float) -> float:
    return min(least + epsilon / picked if picked else np.inf, knn)


def density_aware_points(df: DataFrame, id_col: str, vector_col: str, budget: int, k: int = 10, epsilon: float = 1e-6, warmup: float = 0.1, start: int | None = None) -> DataFrame:
    """``rank, id, distance``: after a plain warm-up of a share of the budget, picks by density times distance.

    The density of a point is the number of points, itself included, within the smaller of its distance to the sample
    (plus ``epsilon`` by sample size) and its distance to the ``k``-th point counted from itself. Density needs the
    distances of all pairs in the neighbourhood, so this is for sets under ``DRIVER_BYTES``; larger ones raise.
    """
    points = _points(df, id_col, vector_col)
    if not _fits(points):
        raise ValueError("density-aware sampling is limited to sets that fit the driver; reduce by farthest_points first")
    ids, x = _local(points)
    spark = df.sparkSession
    n = len(ids)
    if budget >= n or budget < 1:
        return spark.createDataFrame([(i, int(v), None) for i, v in enumerate(ids[: max(budget, 0)])], PICKS)
    near = max(1, min(k, n - 1))
    # sorted distances of each point up to the k-th: no radius exceeds the last of them
    sorted_near = np.stack([np.partition(d := _to(x, x[i]), near - 1)[:near] for i in range(n)])
    sorted_near.sort(axis=1)
    knn = sorted_near[:, -1]
    ties = np.array([(_to(x, x[i]) <= knn[i]).sum() for i in range(n)])
    at = int(np.searchsorted(ids, start)) if start is not None else 0
    rows: list[tuple[int, int, float | None]] = [(0, int(ids[at]), None)]
    taken = np.zeros(n, dtype=bool)
    taken[at] = True
    least = _to(x, x[at])
    plain = max(1, int(warmup * budget))
    while len(rows) < budget:
        score = least
        if len(rows) >= plain:
            radius = np.minimum(least + epsilon / len(rows), knn)
            density = np.where(radius >= knn, ties, (sorted_near <= radius[:, None]).sum(1))
            score = np.where(taken, 0, density) * least
        at = int(score.argmax())
        if score[at] <= 0:
            break
        rows.append((len(rows), int(ids[at]), float(least[at])))
        taken[at] = True
        least = np.minimum(least, _to(x, x[at]))
    return spark.createDataFrame(rows, PICKS)


def _nearest_sample(points: DataFrame, sample: np.ndarray) -> DataFrame:
    """Adds ``d``, the distance to the nearest sample point, in a narrow pass; the sample is of bounded size."""
    ship(points.sparkSession)
    shared = points.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            d = np.full(len(x), np.inf)
            for p in shared.value:
                d = np.minimum(d, _to(x, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["id", "v", "d"])

    return points.mapInArrow(run, "id long, v array<double>, d double")


def _sample_of(points: DataFrame, picks: DataFrame) -> np.ndarray:
    """Vectors of the picks; their number is the budget of the sample, checked against ``DRIVER_BYTES``."""
    chosen = points.join(picks.select("id"), "id", "left_semi")
    if not _fits(chosen):
        raise ValueError("the sample is too large to broadcast")
    return _local(chosen)[1]


def fill_distance(df: DataFrame, id_col: str, vector_col: str, picks: DataFrame) -> DataFrame:
    """``fill_distance``: largest distance of any point to its nearest pick; NULL without points."""
    points = _points(df, id_col, vector_col)
    return _nearest_sample(points, _sample_of(points, picks)).agg(F.max("d").alias("fill_distance"))


def weighted_fill_distance(df: DataFrame, id_col: str, vector_col: str, picks: DataFrame, k: int = 10, epsilon: float = 1e-6, include_self: bool = False) -> DataFrame:
    """``weighted_fill_distance``: largest product of density and distance over points not picked.

    ``include_self`` says whether the ``k``-th neighbour is counted from the point itself, as in the sampling. All pairs count, so
    the set must fit the driver as there.
    """
    points = _points(df, id_col, vector_col)
    if not _fits(points):
        raise ValueError("weighted fill distance is limited to sets that fit the driver")
    ids, x = _local(points)
    chosen = np.isin(ids, [r["id"] for r in picks.select("id").collect()])
    sample = x[chosen]
    best = 0.0
    nth = min(k, len(ids) - 1) - (1 if include_self else 0)
    for i in np.flatnonzero(~chosen):
        d = _to(x, x[i])
        least = _to(sample, x[i]).min() if len(sample) else np.inf
        radius = _radius(least, len(sample), epsilon, np.partition(d, nth)[nth])
        best = max(best, float((d <= radius).sum() * least))
    return df.sparkSession.createDataFrame([(best,)], "weighted_fill_distance double")


def select_diverse(df: DataFrame, id_col: str, vector_col: str, threshold: float, budget: int, start: int | None = None) -> DataFrame:
    """Greedy de-duplication, then farthest points among what is left, joined back: the rows with their ``rank``."""
    from curaspark.operators.similarity import greedy_dedup

    kept = materialize(greedy_dedup(df, id_col, vector_col, threshold), "kept")
    picks = farthest_points(kept, id_col, vector_col, budget, start)
    return kept.join(picks.select(F.col("id").alias(id_col), "rank"), id_col)
