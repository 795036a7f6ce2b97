from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from curaspark.llm import english as en
from curaspark.llm.langid import FEATURES, word_features


def by_hand(times):
    """Counts of features, and the common words."""
    words = list(times)
    ids, of = word_features(words)
    count = np.bincount(ids, weights=np.array([times[w] for w in words], dtype=float)[of], minlength=FEATURES)
    return count, frozenset(sorted(words, key=lambda w: (-times[w], w))[: en.COMMON])


def test_every_row_is_counted(spark):
    """More rows than any sample was meant to have, each with words of its own."""
    letters = lambda column: F.translate(column.cast("string"), "0123456789", "abcdefghij")
    rows = spark.range(25_000).select(F.col("id").alias("task_id"), F.concat(F.lit("A weaver of "), letters(F.col("id"))).alias("persona"), F.concat(F.lit("a weaver of "), letters(F.col("id") + 50_000)).alias("text"))
    got = en.fit(rows, "persona", "text", "task_id")
    texts = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "persona"), F.lit(5))).collect()
    every = Counter(w for r in texts for x in (r["persona"], r["text"]) for w in en.english_words(x))
    count, common = by_hand(every)
    assert len(every) > 50_000
    assert np.array_equal(got.logs, np.log((count + en.SMOOTH) / (count.sum() + en.SMOOTH * FEATURES)).astype(np.float32)) and got.common == common
    total = 0.0
    for fold in range(5):
        own = [en.english_words(r["persona"]) for r in texts if r["fold"] == fold]
        model = en.English(*by_hand(every - Counter(w for words in own for w in words)))
        total += sum(map(model.score, own))
    assert abs(got.level - total / len(texts)) < 1e-5


def test_counts_leave_in_parts(monkeypatch):
    monkeypatch.setattr(en, "COUNT_WORDS", 2)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"one two {w}", "one"]), pa.array([0, 1], type=pa.int64())], names=["text", "fold"]) for w in ("three", "four", "five")]
    parts = [r for part in en._count(SimpleNamespace(value=None))(iter(batches)) for r in part.to_pylist()]
    total = Counter()
    for r in parts:
        total[r["word"], r["fold"]] += r["n"]
    assert total == {("one", 0): 3, ("two", 0): 3, ("three", 0): 1, ("four", 0): 1, ("five", 0): 1, ("one", 1): 3}
    assert len(parts) == 12
