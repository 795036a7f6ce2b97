import datetime as dt
import random

import pytest

from curaspark.llm import target_sample as ts

LABELLED = "original_idx long, `group` string, vote_label boolean, labeled_at timestamp_ntz, key int"
TARGETS = "`group` string, vote_label boolean, target_share double, min_rows long"
T0 = dt.datetime(2025, 1, 1)


@pytest.mark.parametrize("seed", range(30))
def test_controlled_rounding_preserves_margins(seed):
    rng = random.Random(seed)
    table = {(f"g{i}", j): rng.choice([0.0, 1.0, rng.random() * 9]) for i in range(rng.randint(1, 9)) for j in (0, 1)}
    total = sum(table.values())
    whole = round(total)
    scale = whole / total if total else 1
    table = {c: x * scale for c, x in table.items()}
    out = ts.controlled_rounding(table, whole)
    assert sum(out.values()) == whole
    for c, x in table.items():
        assert abs(out[c] - x) < 1
    for axis in (0, 1):
        for v in {c[axis] for c in table}:
            exact, got = sum(x for c, x in table.items() if c[axis] == v), sum(x for c, x in out.items() if c[axis] == v)
            assert abs(exact - got) < 1


def _data(spark, n=4000):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        g = rng.choice(["A", " a ", "b", None, "  ", "C"] if rng.random() < 0.6 else ["a"])
        rows.append((i, g, rng.random() < 0.3, T0, 1))
        if i % 50 == 0:
            rows.append((i, "b", True, T0 + dt.timedelta(days=1), 2))
        if i % 70 == 0:
            rows.append(rows[-1])
    return spark.createDataFrame(rows, LABELLED)


def test_sample_fills_its_quotas_exactly(spark):
    df = _data(spark)
    targets = spark.createDataFrame([("a", True, 0.3, 5), ("a", False, 0.2, 5), ("b", True, 0.2, 5), ("b", False, 0.1, 5), ("Unknown", False, 0.1, 3), ("c", True, 0.09, 3), ("none", True, 0.01, 4)], TARGETS)
    report = {(r["group"], r["is_hate"]): r for r in ts.report(df, targets).collect()}
    drawn = ts.sample(df, targets).collect()
    assert len({r["original_idx"] for r in drawn}) == len(drawn) == sum(r["quota"] for r in report.values()) == 400
    for cell, r in report.items():
        assert sum((d["group"], d["is_hate"]) == cell for d in drawn) == r["quota"]
        assert r["quota"] >= min(r["available"], r["min_rows"])
    assert report["none", 1]["missing"] == 4
    again = {r["original_idx"] for r in ts.sample(df.repartition(7), targets).collect()}
    assert again == {r["original_idx"] for r in drawn}


def test_hot_cell_takes_no_shortcut(spark, monkeypatch):
    monkeypatch.setattr(ts, "KEY_BITS", 1)  # the boundary bucket is then half of the cell
    rows = [(i, "hot", False, T0, 1) for i in range(500)]
    drawn = ts.sample(spark.createDataFrame(rows, LABELLED), spark.createDataFrame([("hot", False, 1.0, 0)], TARGETS)).count()
    assert drawn == 50


def test_nulls_and_empty_tables(spark):
    empty, none = spark.createDataFrame([], LABELLED), spark.createDataFrame([], TARGETS)
    targets = spark.createDataFrame([("a", None, None, None), ("a", False, 0.5, 2)], TARGETS)
    assert ts.sample(empty, targets).count() == 0 and ts.report(empty, targets).collect()[0]["missing"] == 2
    assert ts.sample(_data(spark, 50), none).count() == 0 and ts.report(_data(spark, 50), none).count() == 0
    odd = spark.createDataFrame([(None, "a", None, None, 1), (1, "A", None, None, 1)], LABELLED)
    assert ts.report(odd, targets).collect()[0]["available"] == 2


def test_every_unmet_cell_is_reported(spark):
    rows = [(i, "a" if i % 2 else "b", i % 3 == 0, T0, 1) for i in range(600)]
    targets = spark.createDataFrame([("a", True, 0.5, 0), ("a", False, 0.2, 40), ("b", True, 0.2, 150), ("b", False, 0.1, 3), ("c", True, 0.0, 2)], TARGETS)
    report = ts.report(spark.createDataFrame(rows, LABELLED), targets).collect()
    got = {(r["group"], r["is_hate"]): (r["need"], r["available"], r["quota"], r["missing"]) for r in report}
    assert got == {("a", 1): (30, 100, 30, 0), ("a", 0): (40, 200, 40, 0), ("b", 1): (150, 100, 100, 50), ("b", 0): (6, 200, 6, 0), ("c", 1): (2, 0, 0, 2)}
    assert all((r["quota"] < r["need"]) == (r["missing"] > 0) for r in report)
    assert abs(sum(r["share_reached"] for r in report) - 1) < 1e-9


def test_many_cells_are_rounded_soon():
    rng = random.Random(4)
    table = {(f"g{i}", j): rng.random() * 9 for i in range(4000) for j in range(3)}
    whole = round(sum(table.values()))
    out = ts.controlled_rounding({c: x * whole / sum(table.values()) for c, x in table.items()}, whole)
    assert sum(out.values()) == whole
