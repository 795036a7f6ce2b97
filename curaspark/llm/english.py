"""Whether a text is English, with a reject class: everything unlike English is rejected, whatever it is.

A word is scored by the log-probability of its letter 3- and 4-grams among English ones and by whether it is among the
``COMMON`` most frequent English words. A text's score is the mean over its n-grams, plus ``KNOWN`` times the share of
common words. What is ``MARGIN`` below the level of English texts is rejected (``FIRST`` by the first fit, which knows
the prompts' words only).

Fitted on all rows: on every distinct English text that is known (the prompts), then also on every answer that the
first fit accepts, so that words of both kinds of text are known. The level is the mean score of all prompts, each
scored by a model that lacks its own fold of ``FOLDS``. With too few texts to learn from, these scores are low as well,
and little is rejected; with fewer than ``FOLDS`` prompts nothing is.

Words are counted where the rows are and added up by Spark; only the counts of ``FEATURES`` features and the common
words come to the driver, however many rows and words there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.llm.langid import FEATURES, SENTENCE_END, WORD, plain_text, word_features
from curaspark.storage import materialize, release

COMMON, KNOWN = 500, 8.0
FIRST, MARGIN = 8.0, 4.5
SMOOTH = 0.05
LEAST = 3
FOLDS = 5
CACHE_WORDS = 400_000
COUNT_WORDS = 100_000
CHUNK = 500


class English:
    """Scores of words, kept once computed; a new one is fitted from the counts of features (none: nothing is known)."""

    def __init__(self, count, common: Iterable[str] = (), level: float = float("-inf")):
        count = count if len(count) else np.zeros(FEATURES)
        self.logs = np.log((count + SMOOTH) / (count.sum() + SMOOTH * FEATURES)).astype(np.float32)
        self.common = frozenset(common)
        self.level = level
        self.kept: dict[str, tuple[float, int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    def _learn(self, words: Iterable[str]) -> None:
        if len(self.kept) > CACHE_WORDS:
            self.kept.clear()
        fresh = list({w for w in words if w not in self.kept})
        if fresh:
            ids, of = word_features(fresh)
            n = np.bincount(of, minlength=len(fresh))
            total = np.bincount(of, weights=self.logs[ids], minlength=len(fresh))
            self.kept.update((w, (t, k, w in self.common)) for w, t, k in zip(fresh, total.tolist(), n.tolist()))

    def score(self, words: list[str]) -> float:
        """Higher is more English; ``words`` of letters a-z, at least one."""
        try:
            values = [self.kept[w] for w in words]
        except KeyError:
            self._learn(words)
            values = [self.kept[w] for w in words]
        total, n, known = map(sum, zip(*values))
        return total / n + KNOWN * known / len(words)

    def scores(self, texts: list[list[str]]) -> list[float]:
        """Of texts that are few enough to be held at once; their new words are learnt together."""
        self._learn(chain.from_iterable(texts))
        return [self.score(words) for words in texts]

    def rejects(self, words: list[str]) -> bool:
        """Not English; fewer than ``LEAST`` words decide nothing."""
        return len(words) >= LEAST and self.score(words) < self.level - MARGIN

    def rejects_text(self, text: str) -> bool:
        """Not English as a whole, or more than half of its words stand in sentences that aren't."""
        plain = plain_text(text)
        words = WORD.findall(plain)
        if len(words) < LEAST:
            return False
        score = self.score(words)
        if score > self.level - MARGIN / 4:  # half of the words in rejected sentences would pull the mean below
            return False
        if score < self.level - MARGIN:
            return True
        sentences = [WORD.findall(x) for x in SENTENCE_END.split(plain)]
        return sum(len(x) for x in sentences if self.rejects(x)) > len(words) / 2


def english_words(text: str | None) -> list[str]:
    """Words of letters a-z, lower-cased, without accents, markup and invisible characters."""
    return WORD.findall(plain_text(text)) if text else []


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[list[str]]]]:
    """Words of ``CHUNK`` texts each, by fold; texts without words are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            texts: dict[int, list[list[str]]] = {}
            for text, fold in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = english_words(text)
                if words:
                    texts.setdefault(fold, []).append(words)
            yield texts


def _count(shared):
    """Texts and their folds -> words by fold and how often they occur, in parts; with a model, of the texts like it only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: English | None = shared.value
        times: dict[int, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for fold, n in times.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(n), type=pa.string()), pa.array([fold] * len(n), type=pa.int64()), pa.array(list(n.values()), type=pa.int64())], names=["word", "fold", "n"])
            times.clear()

        for chunk in _chunks(batches):
            for fold, texts in chunk.items():
                if model is not None:
                    texts = [x for x, score in zip(texts, model.scores(texts)) if len(x) >= LEAST and score >= model.level - FIRST]
                times.setdefault(fold, Counter()).update(chain.from_iterable(texts))
            if sum(map(len, times.values())) > COUNT_WORDS:
                yield from counted()
        yield from counted()

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts by model -> features and their counts by model."""
    total = np.zeros((FOLDS + 1, FEATURES), dtype=np.int64)
    for batch in batches:
        if batch.num_rows:
            ids, of = word_features(batch.column(0).to_pylist())
            for k in range(FOLDS + 1):
                total[k] += np.bincount(ids, weights=batch.column(k + 1).to_numpy()[of], minlength=FEATURES).astype(np.int64)
    at = np.flatnonzero(total[FOLDS])
    yield pa.RecordBatch.from_arrays([pa.array(at, type=pa.int64()), *[pa.array(x[at]) for x in total]], names=["feature", *_MODELS])


def _scores(shared):
    """Texts and their folds -> their scores, each by the model without its fold, added up in millionths, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = n = 0
        for chunk in _chunks(batches):
            for fold, texts in chunk.items():
                total += sum(round(1e6 * x) for x in shared.value[fold].scores(texts))
                n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total], type=pa.int64()), pa.array([n], type=pa.int64())], names=["total", "n"])

    return run


_MODELS = [f"m{k}" for k in range(FOLDS + 1)]  # counts without each fold, then of all


def _models(counts: DataFrame) -> list[English]:
    """From words by fold: a model without each fold's texts, then one of all texts."""
    without = [F.sum(F.when(F.col("fold") == k, 0).otherwise(F.col("n"))).alias(_MODELS[k]) for k in range(FOLDS)]
    words = materialize(counts.groupBy("word").agg(*without, F.sum("n").alias(_MODELS[FOLDS])), "english-words")
    tops = [words.where(F.col(m) > 0).orderBy(F.desc(m), "word").limit(COMMON).select(F.lit(m).alias("model"), "word") for m in _MODELS]
    common: dict[str, list[str]] = {m: [] for m in _MODELS}
    for r in reduce(DataFrame.unionAll, tops).collect():  # COMMON a model
        common[r["model"]].append(r["word"])
    made = words.mapInArrow(_features, f"feature long, {', '.join(f'{m} long' for m in _MODELS)}")
    found = made.groupBy("feature").agg(*[F.sum(m).alias(m) for m in _MODELS]).toPandas()  # FEATURES at most
    release(words)
    models = []
    for m in _MODELS:
        count = np.zeros(FEATURES)
        count[found["feature"].to_numpy(dtype=np.int64)] = found[m].to_numpy(dtype=float)
        models.append(English(count, common[m]))
    return models


def fit(rows: DataFrame, known: str, others: str, id_col: str | None = None) -> English:
    """From all ``known`` texts, which are English, and those of ``others`` that are like them. No row is left out, so ``id_col`` isn't needed."""
    spark = rows.sparkSession
    texts = rows.where(F.col(known).isNotNull()).select(F.col(known).alias("text")).distinct()
    prompts = materialize(texts.withColumn("fold", F.pmod(F.xxhash64(F.lit(6), "text"), F.lit(FOLDS))), "english-prompts")
    answers = rows.where(F.col(others).isNotNull()).select(F.col(others).alias("text"), F.lit(FOLDS).cast("long").alias("fold"))

    def counts(table: DataFrame, like: English | None) -> DataFrame:
        made = table.mapInArrow(_count(spark.sparkContext.broadcast(like)), "word string, fold long, n long")
        return made.groupBy("word", "fold").agg(F.sum("n").alias("n"))

    def levelled(models: list[English]) -> English:
        made = prompts.mapInArrow(_scores(spark.sparkContext.broadcast(models)), "total long, n long").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
        if made["n"] and made["n"] >= FOLDS:
            models[FOLDS].level = made["t"] / made["n"] / 1e6
        return models[FOLDS]

    words = materialize(counts(prompts, None), "english-prompt-words")
    first = levelled(_models(words))
    model = levelled(_models(words.unionAll(counts(answers, first))))
    release(prompts, words)
    return model
