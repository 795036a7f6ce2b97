"""Sample matching target category proportions by controlled rounding (problem 2).

A cell needs the larger of its minimum and its share of the sample size, rounded down. The wanted table of quotas is
fractional: each cell gets what it needs, or all that it has, and the rest of the sample is dealt in proportion to the
shares. Needs come first: where they exceed the sample size, as minima can, the sample is as large as they are together.
*Controlled rounding* makes the table integer: a feasible circulation found by maximum flow gives each cell the floor or
ceiling of its quota, and each row and column sum the floor or ceiling of its margin. A cell whose integer quota is
below its need is reported, which happens only where it has too few items. Each cell then takes exactly its quota
of items with the smallest seeded hash keys.

Skew: a cell may hold any share of the rows. Keys are counted by cell and leading key bits; only the one
bucket of a cell in which its quota ends is ranked.

Defined results: groups are compared trimmed and lower-cased, NULL or blank is 'unknown'; a NULL label counts
as 0; of an item's rows the one with the latest ``labeled_at`` counts, ties by the largest group and label;
items of cells without target are never drawn; repeated target cells add their shares and keep the largest
minimum; NULL shares and minima count as 0; empty tables give an empty sample. Target cells are planned on the driver;
more than ``MAX_CELLS`` raise.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curaspark.storage import materialize

MAX_CELLS = 200_000
KEY_BITS = 12
SNAP = 1e-9


def cell_group(column: str) -> F.Column:
    """The group as it is compared."""
    stripped = F.lower(F.regexp_replace(F.col(column), r"(?U)^[\s\x{200B}\x{FEFF}]+|[\s\x{200B}\x{FEFF}]+$", ""))
    return F.when(F.coalesce(stripped, F.lit("")) == "", F.lit("unknown")).otherwise(stripped)


def latest_items(labelled: DataFrame) -> DataFrame:
    """``original_idx, group, is_hate``: one row per item."""
    row = F.struct(
        F.col("labeled_at"), cell_group("group").alias("group"), F.coalesce(F.col("vote_label"), F.lit(False)).cast("long").alias("is_hate")
    )
    latest = labelled.groupBy("original_idx").agg(F.max(row).alias("last"))
    return latest.select("original_idx", F.col("last.group").alias("group"), F.col("last.is_hate").alias("is_hate"))


def target_cells(targets: DataFrame) -> DataFrame:
    """``group, is_hate, share, min_rows`` by cell."""
    return targets.groupBy(cell_group("group").alias("group"), F.coalesce(F.col("vote_label"), F.lit(False)).cast("long").alias("is_hate")).agg(
        F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("long").alias("min_rows")
    )


def _bounds(x: float) -> tuple[int, int]:
    near = round(x)
    return (near, near) if abs(x - near) <= SNAP * max(1.0, abs(x)) else (math.floor(x), math.ceil(x))


def max_flow(n: int, edges: list[tuple[int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each edge (from, to, capacity) of a maximum flow: level graph by breadth-first search, then blocking paths."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        head[a].append(len(to))
        to.append(b)
        room.append(c)
        head[b].append(len(to))
        to.append(a)
        room.append(0)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [room[2 * i + 1] for i in range(len(edges))]
        at = [0] * n
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while at[a] < len(head[a]):
                e = head[a][at[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(head[a]):
                path.append(head[a][at[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                at[a] += 1
            else:
                break


def controlled_rounding(table: dict[tuple[str, int], float], total: int) -> dict[tuple[str, int], int]:
    """Integer table with every cell and both margins rounded down or up, and the given total."""
    rows, columns = sorted({r for r, _ in table}), sorted({c for _, c in table})
    row_at = {r: 2 + i for i, r in enumerate(rows)}
    column_at = {c: 2 + len(rows) + i for i, c in enumerate(columns)}
    source, sink = 0, 1
    extra_source, extra_sink = 2 + len(rows) + len(columns), 3 + len(rows) + len(columns)
    row_sum: dict[str, list[float]] = defaultdict(list)
    column_sum: dict[int, list[float]] = defaultdict(list)
    for (r, c), x in table.items():
        row_sum[r].append(x)
        column_sum[c].append(x)
    bounded = [(source, row_at[r], *_bounds(math.fsum(row_sum[r]))) for r in rows]
    bounded += [(row_at[r], column_at[c], *_bounds(x)) for (r, c), x in sorted(table.items())]
    bounded += [(column_at[c], sink, *_bounds(math.fsum(column_sum[c]))) for c in columns]
    bounded.append((sink, source, total, total))
    need = [0] * (extra_sink + 1)
    edges = []
    for a, b, low, high in bounded:
        edges.append((a, b, high - low))
        need[b] += low
        need[a] -= low
    k = len(edges)
    edges += [(extra_source, v, x) for v, x in enumerate(need) if x > 0] + [(v, extra_sink, -x) for v, x in enumerate(need) if x < 0]
    flow = max_flow(extra_sink + 1, edges, extra_source, extra_sink)
    if any(flow[i] != edges[i][2] for i in range(k, len(edges)) if edges[i][0] == extra_source):
        raise ArithmeticError("no controlled rounding with this total")
    first = len(rows)
    return {cell: bounded[first + i][2] + flow[first + i] for i, cell in enumerate(sorted(table))}


def fractional_quotas(cells: list[dict], total: int) -> dict[tuple[str, int], float]:
    """Quota of each cell between its need and what it has, otherwise in proportion to its share; they sum to ``total``, or to the needs, or to what fits."""
    low = [min(c["available"], c["need"]) for c in cells]
    high = [c["available"] if c["share"] > 0 else lo for c, lo in zip(cells, low)]
    total = min(max(total, sum(low)), sum(high))
    want = lambda scale: [min(max(c["share"] * scale, lo), hi) for c, lo, hi in zip(cells, low, high)]
    if sum(low) >= total:
        quotas = [float(x) for x in low]
    elif sum(high) <= total:
        quotas = [float(x) for x in high]
    else:
        a, b = 0.0, 1.0
        while math.fsum(want(b)) < total and b < 1e18:
            b *= 2
        for _ in range(100):
            middle = (a + b) / 2
            a, b = (middle, b) if math.fsum(want(middle)) < total else (a, middle)
        quotas = [float(x) for x in want(b)]
    return {(c["group"], c["is_hate"]): q for c, q in zip(cells, quotas)}


def plan(items: DataFrame, targets: DataFrame, size: int) -> list[dict]:
    """Each target cell with its need, what is available, its integer quota and what is missing; cells are bounded by ``MAX_CELLS``."""
    wanted = target_cells(targets).limit(MAX_CELLS + 1).collect()
    if len(wanted) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} target cells")
    counts = items.join(F.broadcast(target_cells(targets).select("group", "is_hate")), ["group", "is_hate"], "left_semi")
    have = {(r["group"], r["is_hate"]): r["n"] for r in counts.groupBy("group", "is_hate").agg(F.count(F.lit(1)).alias("n")).collect()}
    cells = []
    for r in sorted(wanted, key=lambda r: (r["group"], r["is_hate"])):
        need = max(r["min_rows"], math.floor(r["share"] * size))
        cells.append(r.asDict() | {"need": need, "available": have.get((r["group"], r["is_hate"]), 0)})
    quotas = fractional_quotas(cells, size)
    rounded = controlled_rounding(quotas, round(math.fsum(quotas.values()))) if cells else {}
    drawn = sum(rounded.values())
    for c in cells:
        c["quota"] = rounded[c["group"], c["is_hate"]]
        c["missing"] = max(0, c["need"] - c["quota"])
        c["share_reached"] = c["quota"] / drawn if drawn else 0.0
    return cells


REPORT = "group string, is_hate long, share double, min_rows long, need long, available long, quota long, missing long, share_reached double"


def report(labelled: DataFrame, targets: DataFrame, one_in: int = 10) -> DataFrame:
    """The plan as a table, for a sample of one item in ``one_in``."""
    items = materialize(latest_items(labelled), "sample-items")
    cells = plan(items, targets, items.count() // one_in)
    names = [x.split()[0] for x in REPORT.split(", ")]
    return labelled.sparkSession.createDataFrame([tuple(c[n] for n in names) for c in cells], REPORT)


def sample(labelled: DataFrame, targets: DataFrame, one_in: int = 10, seed: int = 42) -> DataFrame:
    """``original_idx, group, is_hate`` of the drawn items."""
    spark = labelled.sparkSession
    key = F.xxhash64(F.lit(seed), F.col("original_idx"))
    items = materialize(latest_items(labelled).withColumn("key", key), "sample-items")
    cells = plan(items, targets, items.count() // one_in)
    quotas = F.broadcast(spark.createDataFrame([(c["group"], c["is_hate"], c["quota"]) for c in cells], "group string, is_hate long, quota long"))
    keyed = items.withColumn("bucket", F.shiftrightunsigned("key", 64 - KEY_BITS)).join(quotas, ["group", "is_hate"])
    counted = keyed.groupBy("group", "is_hate", "bucket", "quota").agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy("group", "is_hate").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # cells times 2^KEY_BITS rows at most
    starts = counted.withColumn("before", F.coalesce(F.sum("n").over(up_to), F.lit(0))).where("before < quota").select("group", "is_hate", "bucket", "n", "before")
    reached = keyed.join(starts, ["group", "is_hate", "bucket"])
    whole = reached.where("before + n <= quota")
    last = reached.where("before + n > quota")
    order = Window.partitionBy("group", "is_hate", "bucket").orderBy("key", "original_idx")
    part = last.withColumn("rank", F.row_number().over(order)).where("before + rank <= quota")
    columns = ["original_idx", "group", "is_hate"]
    return whole.select(columns).unionAll(part.select(columns))
