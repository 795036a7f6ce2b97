import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.operators import diversity, metrics, relational, sampling, similarity, votes


# votes
def _verdicts(spark, rows):
    return spark.createDataFrame([(i, f"j{k}", {"T": True, "F": False, "N": None}[v], "raw") for i, votes_ in rows for k, v in enumerate(votes_)], "original_idx long, judge string, is_hate boolean, raw string")


def test_majority_has_an_absolute_threshold(spark):
    rows = [(1, "TTTTFF"), (2, "TTTFFF"), (3, "TTTTNN"), (4, "TTTNNN"), (5, "NNNNNN")]
    got = {r["original_idx"]: (r["vote_label"], r["hate_votes"], r["total_votes"]) for r in votes.majority(_verdicts(spark, rows)).collect()}
    assert got == {1: (True, 4, 6), 2: (False, 3, 6), 3: (True, 4, 4), 4: (False, 3, 3), 5: (None, 0, 0)}


def test_short_texts_are_not_labelled(spark):
    texts = spark.createDataFrame([(1, " 123456789 "), (2, "1234567890"), (3, None), (4, "long enough text")], "original_idx long, text string")
    got = {r["original_idx"]: (r["vote_label"], r["hate_votes"]) for r in votes.label_texts(texts, _verdicts(spark, [(1, "TTTT"), (2, "TTTT"), (3, "TTTT")])).collect()}
    assert got == {1: (None, None), 2: (True, 4), 3: (None, None), 4: (None, None)}


def test_add_judge_counts_stored_nulls_as_judged(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "original_idx long")
    before = _verdicts(spark, [(1, "TTT"), (2, "TTTN")])
    more = spark.createDataFrame([(1, "j3", True, "x"), (2, "j3", True, "x")], before.schema)
    got = {r["original_idx"]: (r["vote_label"], r["hate_votes"], r["total_votes"]) for r in votes.add_judge(items, before, more).collect()}
    assert got == {1: (True, 4, 4), 2: (False, 3, 3), 3: (None, 0, 0)}
    again = votes.add_judge(items, before.unionByName(more.where("original_idx = 1")), more)
    assert {r["original_idx"]: r["hate_votes"] for r in again.collect()}[1] == 4


def test_wide_and_long_round_trip(spark):
    wide = spark.createDataFrame([(1, True, "yes", None, ""), (2, False, "no", True, "1")], "original_idx long, judge_a boolean, judge_a_raw string, judge_b boolean, judge_b_raw string")
    assert sorted(votes.to_wide(votes.to_long(wide, ["a", "b"]), ["a", "b"]).collect()) == sorted(wide.collect())


def test_distribution_of_nothing(spark):
    row = votes.label_distribution(spark.createDataFrame([], "vote_label boolean")).first()
    assert row["total"] == 0 and row["hate_pct"] is None


# samples
def _grouped(spark):
    rows = [(k, "a" if k < 60 else "b" if k < 80 else None, k % 3 == 0 if k % 7 else None) for k in range(100)]
    return spark.createDataFrame(rows, "id long, g string, v boolean")


@pytest.mark.parametrize("prefix", [1, 3])
def test_balanced_sample(spark, monkeypatch, prefix):
    monkeypatch.setattr(sampling, "PREFIX", prefix)
    df = _grouped(spark)
    out = sampling.balanced_sample(df, F.col("g"), F.col("v"), "id", 5)
    counts = {(r["grp"], r["split_label"]): r["count"] for r in out.groupBy("grp", "split_label").count().collect()}
    assert all(counts[g, 0] == counts[g, 1] <= 5 for g in ("a", "b", "unknown"))
    assert {r["id"] for r in out.collect()} == {r["id"] for r in sampling.balanced_sample(df.repartition(9), F.col("g"), F.col("v"), "id", 5).collect()}
    with pytest.raises(ValueError):
        sampling.balanced_sample(df.where("coalesce(v, false) or id < 3"), F.col("g"), F.col("v"), "id", 5, strict=True)


def test_take_quota_is_exact(spark):
    df = spark.createDataFrame([(k, None if k % 2 else "x", 7 if k % 2 else None) for k in range(50)], "id long, cell string, quota int")
    out = sampling.take_quota(df, ["cell"], "quota", "id").collect()
    assert len(out) == 7 and all(r["cell"] is None for r in out)


def test_split_and_downsample(spark):
    df = spark.createDataFrame([(k, 1 if k < 15 else 0 if k < 96 else None) for k in range(100)], "id long, label int")
    split = sampling.stratified_split(df, "label", "id")
    assert {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()} == {(1, "test"): 2, (1, "train"): 13, (0, "test"): 9, (0, "train"): 72, (None, "test"): 1, (None, "train"): 3}
    down = sampling.balanced_downsample(df, "label", "id", 40).collect()
    assert sum(r["label"] == 1 for r in down) == 15 and len(down) == 35
    assert sampling.balanced_downsample(df, "label", "id", 100).count() == 100
    assert sampling.random_sample(df, "id", 7).count() == 7 and sampling.random_sample(df, "id", 700).count() == 100


# ids and joins
def test_dense_ids(spark):
    rows = [(k * 37 % 101, f"t{k}") for k in range(101)]
    out = relational.dense_ids(spark.createDataFrame(rows, "ord long, t string").repartition(6), ["ord"]).collect()
    assert all(r["id"] == r["ord"] for r in out) and len(out) == 101
    assert relational.dense_ids(spark.createDataFrame([], "ord long"), ["ord"]).count() == 0


def test_union_grid_and_prefix(spark):
    a, b = spark.createDataFrame([(5, "x"), (2, "y")], "ord long, persona string"), spark.createDataFrame([(1, "z"), (3, None)], "ord long, persona string")
    union = sorted(relational.union_with_ids([("thread", a), ("hub", b)], "ord", "persona").collect())
    assert [(r["id"], r["persona"], r["source"]) for r in union] == [(0, "y", "thread"), (1, "x", "thread"), (2, "z", "hub"), (3, None, "hub")]
    grid = relational.task_grid(relational.union_with_ids([("thread", a)], "ord", "persona"))
    assert sorted(r["task_id"] for r in grid.collect()) == list(range(136))
    row = grid.where("task_id = 68 + 2 * 3 + 1").first()
    assert (row["persona_id"], row["group"], row["sentiment"]) == ("1", "Middle Eastern", "negative")
    assert relational.prefix(a, "ord", 0).count() == 0 and relational.prefix(a, "ord", None).count() == 2


def test_resume(spark):
    done = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, "x", 1)], "k long, v string, n int")
    fresh = spark.createDataFrame([(2, "again", 9), (3, "y", 9), (None, "z", 9)], done.schema)
    assert {(r["k"], r["v"]) for r in relational.resume(done, fresh, "k", ["n"]).collect()} == {(1, "new"), (2, "x"), (3, "y"), (None, "z")}
    assert relational.label_or_split(spark.createDataFrame([(1,)], "split_label int")).columns == ["split_label", "label"]
    assert relational.label_or_split(spark.createDataFrame([(1, 2)], "split_label int, label int")).first()["label"] == 2


# metrics
def test_benchmarks_and_metrics(spark):
    bench = metrics.bench_without_offensive(spark.createDataFrame([("a", "hate", 1), ("b", "offensive", 1), ("c", None, 0)], "text string, label string, ground_truth int"), "x")
    assert {r["text"] for r in bench.collect()} == {"a", "c"}
    three = metrics.bench_three_classes(spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", None)], "tweet string, class int"), "y")
    assert {(r["text"], r["label"]) for r in three.collect()} == {("a", 1), ("c", 0)}
    rated = metrics.bench_rated(spark.createDataFrame([("a", 1.9), ("b", None)], "text string, label double"), "z")
    assert [(r["text"], r["label"]) for r in rated.collect()] == [("a", 1)]
    rows = [("neg", 1, 0), ("neg", 0, 0), ("one", 1, 1)] + [("one", 1, 0)] * 15 + [("null", 1, None), ("null", 1, 1)]
    got = {r["dataset"]: r for r in metrics.binary_metrics(spark.createDataFrame(rows, "dataset string, label int, pred int")).collect()}
    assert (got["neg"]["accuracy"], got["neg"]["f1"], got["neg"]["precision"], got["neg"]["recall"]) == (50.0, 0.0, 0.0, 0.0)
    assert got["one"]["accuracy"] == 6.2 and got["one"]["precision"] == 100.0 and got["null"]["samples"] == 1
    assert metrics.binary_metrics(spark.createDataFrame([], "dataset string, label int, pred int")).count() == 0


# vectors
def _vectors(n=120, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 :] = x[: n - n // 2] + 0.2 * rng.normal(size=(n - n // 2, d))
    x[3] = x[7]
    x[11] = 0
    return x


def _frame(spark, x):
    return spark.createDataFrame([(k, v.tolist(), "x") for k, v in enumerate(x)], "id long, v array<double>, a string")


def _greedy(x, t):
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    kept = []
    for i in range(len(u)):
        if all(u[i] @ u[j] <= t for j in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("block, pivots, driver", [(2000, 64, 2_000_000), (7, 5, 2_000_000), (2000, 3, 0)])
@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_greedy_dedup_equals_the_sequential_rule(spark, monkeypatch, block, pivots, driver, threshold):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PIVOTS", pivots)
    monkeypatch.setattr(similarity, "DRIVER_EDGES", driver)
    x = _vectors()
    kept = sorted(r["id"] for r in similarity.greedy_dedup(_frame(spark, x), "id", "v", threshold).collect())
    assert kept == _greedy(x, threshold)


def test_dedup_is_strict_not_transitive_and_handles_little(spark):
    angle = [0, math.acos(0.8), 2 * math.acos(0.8)]
    chain = np.array([[math.cos(a), math.sin(a)] for a in angle])
    assert [r["id"] for r in similarity.greedy_dedup(_frame(spark, chain), "id", "v", 0.79).collect()] == [0, 2]
    same = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert similarity.cosine_edges(_frame(spark, same), "id", "v", 0.0).count() == 0
    assert similarity.greedy_dedup(_frame(spark, same[:1]), "id", "v").count() == 1
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert similarity.greedy_dedup(empty, "id", "v").count() == 0
    assert similarity.dedup_ratio(empty, empty).first()["removed_pct"] is None
    odd = spark.createDataFrame([(1, None), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    assert sorted(r["id"] for r in similarity.greedy_dedup(odd, "id", "v").collect()) == [1, 2]


def _fps(x, budget, start=0):
    picks = [start]
    least = np.linalg.norm(x - x[start], axis=1)
    while len(picks) < budget and least.max() > 0:
        picks.append(int(least.argmax()))
        least = np.minimum(least, np.linalg.norm(x - x[picks[-1]], axis=1))
    return picks


def test_farthest_points(spark, monkeypatch):
    x = _vectors(60)
    df = _frame(spark, x)
    want = _fps(x, 12, 4)
    monkeypatch.setattr(diversity, "STATE_EVERY", 4)
    for limit in (1 << 30, 0):  # on the driver, and distributed
        got = [(r["rank"], r["id"]) for r in diversity.farthest_points(df, "id", "v", 12, 4, limit).orderBy("rank").collect()]
        assert got == list(enumerate(want))
        assert diversity.farthest_points(df, "id", "v", 60, None, limit).count() == 60
    distances = [r["distance"] for r in diversity.farthest_points(df, "id", "v", 20).orderBy("rank").collect()][1:]
    assert distances == sorted(distances, reverse=True)
    copies = _frame(spark, np.array([[0.0], [1.0], [1.0], [0.0], [0.0]]))
    assert [r["id"] for r in diversity.farthest_points(copies, "id", "v", 4).orderBy("rank").collect()] == [0, 1]
    assert diversity.farthest_points(df, "id", "v", 0).count() == 0


def _dafps(x, budget, k, epsilon, warmup, start):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    picks = [start]
    near = max(1, min(k, len(x) - 1))
    rho = np.sort(d, axis=1)[:, near - 1]
    while len(picks) < budget:
        least = d[:, picks].min(1)
        score = least.copy()
        if len(picks) >= max(1, int(warmup * budget)):
            r = np.minimum(least + epsilon / len(picks), rho)
            score = (d <= r[:, None]).sum(1) * least
            score[picks] = 0
        picks.append(int(score.argmax()))
    return picks


def test_density_aware_points_and_fill_distances(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate([rng.normal((0, 0), 0.5, (70, 2)), rng.normal((5, 5), 1.5, (20, 2)), rng.normal((-3, 4), 0.8, (35, 2))])
    df = _frame(spark, x)
    picks = diversity.density_aware_points(df, "id", "v", 15, start=2)
    got = [r["id"] for r in picks.orderBy("rank").collect()]
    assert got == _dafps(x, 15, 10, 1e-6, 0.1, 2)
    d = np.linalg.norm(x[:, None] - x[got][None], axis=2).min(1)
    assert diversity.fill_distance(df, "id", "v", picks).first()[0] == pytest.approx(d.max())
    full = np.linalg.norm(x[:, None] - x[None], axis=2)
    rho = np.sort(full, axis=1)[:, 10]
    w = (full <= np.minimum(d + 1e-6 / len(got), rho)[:, None]).sum(1) * d
    w[got] = 0
    assert diversity.weighted_fill_distance(df, "id", "v", picks).first()[0] == pytest.approx(w.max())
    assert diversity.density_aware_points(df, "id", "v", 500).count() == len(x)
    plain = diversity.farthest_points(df, "id", "v", 15, 2)
    assert diversity.fill_distance(df, "id", "v", plain).first()[0] <= 2 * d.max()


def test_select_diverse(spark):
    x = _vectors(60)
    out = diversity.select_diverse(_frame(spark, x), "id", "v", 0.9, 8)
    kept = _greedy(x, 0.9)
    want = [kept[k] for k in _fps(x[kept], 8)]
    assert [r["id"] for r in out.orderBy("rank").collect()] == want and "a" in out.columns
