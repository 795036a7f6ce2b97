import numpy as np
import pytest
from pyspark.sql import functions as F

from curaspark.llm import subset

SCHEMA = "ord long, persona string, extra int, id long"


def _rows(n_big=300, n_small=25):
    rng = np.random.default_rng(0)
    topics = {t: [f"{t}{k}" for k in range(12)] for t in ("wood", "ship", "bread", "law")}
    rows = []
    for t, n in zip(topics, (n_big, n_small, n_small, n_small)):
        for _ in range(n):
            words = list(rng.choice(topics[t], 6, replace=False)) + list(rng.choice([f"any{k}" for k in range(60)], 4, replace=False))
            rows.append((len(rows), "a person who likes " + " ".join(words), 1, 7))
    return rows


def test_covers_small_kinds_and_damps_large_ones(spark):
    rows = _rows()
    picked = subset.choose(spark.createDataFrame(rows, SCHEMA), 20).collect()
    assert len(picked) == len({r["ord"] for r in picked}) == 20
    text = {r[0]: r[1] for r in rows}
    kinds = [next(t for t in ("wood", "ship", "bread", "law") if t in text[r["ord"]]) for r in picked]
    assert set(kinds) == {"wood", "ship", "bread", "law"}
    assert kinds.count("wood") <= 7  # 80 % of the rows, a quarter of the kinds


def test_copies_nulls_and_blank_texts(spark):
    rows = [(k, "Same WORDS here", 1, 1) for k in range(50)] + [(90, None, 1, 1), (91, " \n", 1, 1), (92, "12 ?", 1, 1), (93, "other words there", 1, 1), (94, "x " * 20000, 1, 1)]
    picked = {r["ord"] for r in subset.choose(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert picked == {0, 93, 94}


@pytest.mark.parametrize("rows", [[], [(1, None, 1, 1)]])
def test_empty(spark, rows):
    assert subset.choose(spark.createDataFrame(rows, SCHEMA), 5).count() == 0


def test_quotas_deal_unused_slots():
    assert subset.quotas({1: 2, 2: 100, 3: 50}, 30) == {1: 2, 2: 14, 3: 14}
    assert subset.quotas({1: 5, 2: 1}, 3) == {1: 2, 2: 1}
    assert subset.quotas({1: 1}, 9) == {1: 1}
    assert subset.quotas({}, 9) == {}


def test_same_result_however_partitioned(spark):
    df = spark.createDataFrame(_rows(60, 10), SCHEMA)
    a = {r["ord"] for r in subset.choose(df.repartition(1), 8).collect()}
    b = {r["ord"] for r in subset.choose(df.repartition(5), 8).collect()}
    assert len(a) == len(b) == 8 and len(a & b) >= 6  # sums in another order may move a border case


def test_frequencies_and_pairs_cover_all_texts(spark):
    lists = subset.word_lists(spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "b"), (4, "a b c")], "id long, text string"))
    counts, total = subset.document_frequencies(lists)
    at = subset._Buckets()
    assert total == 4 and counts[at["b"]] == 4
    core = np.array([at[w] for w in "abc"])
    pairs = subset.pair_counts(lists, core)
    assert (pairs + pairs.T).tolist() == [[0, 2, 1], [2, 0, 2], [1, 2, 0]]


def test_topics_show_as_a_drop_of_eigenvalues():
    rng = np.random.default_rng(1)
    held = np.zeros((2000, 40))
    for k, row in enumerate(held):
        row[8 * (k % 5) + rng.choice(8, 4, replace=False)] = 1
    pairs = np.triu(held.T @ held, 1)
    assert subset.topical_table(pairs, held.sum(0), len(held)).shape == (40, 5)
    assert subset.topical_table(np.zeros((1, 1)), np.ones(1), 1).shape == (1, 0)


def _x(*values):
    return F.lit(bytearray(np.array(values, dtype=np.float16).tobytes()))


def test_a_text_of_any_batch_can_open_a_cluster(spark):
    many = spark.range(24000).select("id", _x(1, 0, 0).alias("x"), F.lit(0).alias("grp"), F.lit(0).alias("batch"))
    few = spark.range(24000, 24100).select("id", _x(0, 0, 1).alias("x"), F.lit(0).alias("grp"), F.lit(4).alias("batch"))
    centres, groups = subset.fit_clusters(many.unionAll(few), {0: 24100}, {0: 2})
    assert sorted(centres.argmax(1).tolist()) == [0, 2] and groups.tolist() == [0, 0]


def test_no_plan_ranks_all_rows_in_one_task(spark):
    from contextlib import redirect_stdout
    from io import StringIO

    chosen = subset.choose(spark.createDataFrame(_rows(60, 10), SCHEMA), 8)
    shown = StringIO()
    with redirect_stdout(shown):
        chosen.explain("formatted")
    assert "SinglePartition" not in shown.getvalue()
