import datetime as dt
import random

import pytest

from curaspark.llm import consensus as co

JUDGES = ["judge_a", "judge_b", "judge_c", "judge_d", "judge_e"]
SCHEMA = "original_idx long, " + ", ".join(f"{j} boolean, {j}_raw string" for j in JUDGES) + ", vote_label boolean, labeled_at timestamp_ntz, n long, judge string"
HIT, FALSE = [0.97, 0.9, 0.8, 0.55, 0.95], [0.03, 0.1, 0.25, 0.45, 0.5]
T0 = dt.datetime(2025, 1, 1)


def _row(i, votes, at=T0):
    return (i, *[x for v in votes for x in (v, "raw")], None, at, 1, "x")


def _data(n=3000, seed=5):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        truth[i] = rng.random() < 0.3
        for again in range(2 if i % 40 == 0 else 1):
            votes = [None if rng.random() < 0.05 else rng.random() < (HIT if truth[i] else FALSE)[k] for k in range(5)]
            rows.append(_row(i, votes, T0 + dt.timedelta(days=again)))
        if i % 90 == 0:
            rows.append(rows[-1])
    return rows, truth


def test_reliabilities_and_labels(spark):
    rows, truth = _data()
    df = spark.createDataFrame(rows, SCHEMA)
    found = {r["judge"]: r for r in co.reliability(df).collect()}
    for k, name in enumerate("abcde"):
        assert found[name]["hit_rate"] == pytest.approx(HIT[k], abs=0.05)
        assert found[name]["false_alarm_rate"] == pytest.approx(FALSE[k], abs=0.05)
    assert found["a"]["reliability"] > found["b"]["reliability"] > found["c"]["reliability"] > found["d"]["reliability"]
    labels = {r["original_idx"]: r["is_hate"] for r in co.consensus(df).collect()}
    right = sum(bool(labels[i]) == t for i, t in truth.items())
    by_majority = {}
    for r in rows:
        votes = [v for v in r[1:11:2] if v is not None]
        by_majority[r[0]] = sum(votes) * 2 > len(votes)
    assert right > 0.96 * len(truth) and right > sum(by_majority[i] == t for i, t in truth.items())


def test_nulls_repeats_and_ties(spark):
    rows = [_row(1, [None] * 5), _row(2, [True] * 5), _row(3, [False] * 5), _row(3, [False] * 5), _row(4, [True, True, True, True, None]), _row(5, [False, False, False, True, False])]
    out = {r["original_idx"]: r for r in co.consensus(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1]["is_hate"] is None and out[1]["n_verdicts"] == 0 and out[1]["agreement"] is None
    assert out[2]["is_hate"] and out[2]["agreement"] == 1.0
    assert out[3]["is_hate"] is False and out[3]["n_verdicts"] == 5  # the repeated row counts once


def test_one_judge_without_overlap_and_empty(spark):
    rows = [_row(1, [True, None, None, None, None]), _row(2, [None, False, None, None, None])]
    assert all(r["reliability"] == 0 for r in co.reliability(spark.createDataFrame(rows, SCHEMA)).collect())
    empty = spark.createDataFrame([], SCHEMA)
    assert co.consensus(empty).count() == 0 and co.reliability(empty).count() == 5


def test_an_item_with_most_rows(spark):
    rows, _ = _data(300)
    rows += [_row(7, [True, True, True, False, True], T0 + dt.timedelta(minutes=k)) for k in range(200)]
    out = {r["original_idx"]: r for r in co.consensus(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[7]["is_hate"] and out[7]["n_verdicts"] >= 1000
