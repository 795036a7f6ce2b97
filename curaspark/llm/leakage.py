"""Evaluation texts that occur inside training texts (problem 6).

The test items form a *BM25 inverted index*. Training texts query it by *passages*: windows of ``WINDOW`` words that
overlap by ``run`` - 1, so that any ``run`` consecutive words lie in one of them and a long text is no wider a query
than a short one; a word that no item has ends a passage, as no run goes across it. Each item has its own threshold: the least BM25 score of any ``run`` consecutive words of it, so a
passage that contains such a run can never score below it. Contributions are divided by their item's threshold, which
makes the threshold 1 for all.

*Block-max WAND*: the terms of a passage are lists of items in order, each with a cursor and its largest contribution.
In order of their cursors' items, the largest contributions are added up until they reach 1: this is the pivot, and no
item before it can reach the threshold; nor can one before the cursor of as many terms as any run has at least. If the largest contributions within the pivot's block of ``BLOCK`` items don't
reach 1 either, the cursors move past the block, else they move to the pivot, which is scored once all are there. All
passages of a batch take each of these steps together in array operations. Items that reach 1 are verified: a run of
words must be common. So the search is exact: it loses no item.

The index is built once a worker and is bounded by ``INDEX_WORDS`` words; a larger test set is cut into several
indexes by item id and each queries all training texts.

Words are runs of letters and digits after HTML unescaping, compatibility decomposition, removal of accents and
invisible characters, mapping of look-alike letters to Latin ones, and case folding.

Defined results: NULL and blank texts match nothing; items of fewer than ``run`` words match nothing; repeated
rows give one result row; items with equal texts are reported each.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curaspark.session import ship

RUN = 8
INDEX_WORDS = 2_000_000
BLOCK = 16
K1, B = 1.2, 0.75
WINDOW = 32
CHUNK = 1024

# Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK_ALIKES = str.maketrans(
    "авгԁеѕіјҟкӏмнорԛтԝухѵһԍոսзցАВЕЅІЈКМНОРСТХУҮԌԚԜҺсαβγεηικνορτυχωϲϳɑɡıΑΒΕΖΗΙΚΜΝΟΡΤΥΧøłđØŁĐ",
    "abrdesijkklmhopqtwyxvhgnuzqabesijkmhopctxyygqwhcabyenikvoptuxwcjagiabezhikmnoptyxoldold",
)
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff]")
ACCENTS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u064b-\u065f\u093c\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099\u309a\ufe20-\ufe2f]+")
PUNCTUATION = "’‘“”«»–—…"
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words by which texts are compared."""
    if not text:
        return []
    if "&" in text:
        while (plain := html.unescape(text)) != text:  # each round is shorter
            text = plain
    if not text.isascii():
        for mark in PUNCTUATION:
            text = text.replace(mark, " ")
        if not text.isascii():
            text = ACCENTS.sub("", INVISIBLE.sub("", unicodedata.normalize("NFKD", text)))
            if not text.isascii():
                text = text.translate(LOOK_ALIKES).casefold()
    return WORD.findall(text.lower())


class Index:
    """Inverted index of test items with block maxima. ``items``: (position, words)."""

    def __init__(self, items: list[list[str]], run: int = RUN):
        self.run = run
        sizes = [len(w) for w in items]
        mean = sum(sizes) / max(1, len(sizes))
        found = Counter(t for words in items for t in set(words))
        self.terms = {t: k for k, t in enumerate(sorted(found))}
        idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in found.items()}
        postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        self.grams: list[set[str]] = []
        self.least = run  # terms that any run has at least
        for at, words in enumerate(items):
            self.grams.append({" ".join(words[i : i + run]) for i in range(len(words) - run + 1)})
            if len(words) < run:
                continue
            part = {t: idf[t] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean)) for t, n in Counter(words).items()}
            least = min(sum(part[t] for t in {*words[i : i + run]}) for i in range(len(words) - run + 1))
            self.least = min(self.least, *(len({*words[i : i + run]}) for i in range(len(words) - run + 1)), run)
            for t, x in part.items():
                postings[self.terms[t]].append((at, x / least))
        # postings in order of term and item, and the largest contribution of each term, and of each term and block
        self.n_items = max(1, len(items))
        entries = [(t, at, x) for t, own in sorted(postings.items()) for at, x in own]
        term = np.array([t for t, _, _ in entries], dtype=np.int64)
        item = np.array([at for _, at, _ in entries], dtype=np.int64)
        self.parts = np.array([x for _, _, x in entries], dtype=float)
        self.keys = np.append(term * self.n_items + item, np.iinfo(np.int64).max)
        self.most = np.zeros(len(self.terms) + 1)
        np.maximum.at(self.most, term, self.parts)
        self.n_blocks = -(-self.n_items // BLOCK)
        place = term * self.n_blocks + item // BLOCK
        self.block_keys, inverse = np.unique(place, return_inverse=True)
        self.block_most = np.zeros(len(self.block_keys) + 1)
        np.maximum.at(self.block_most, inverse, self.parts)
        self.block_keys = np.append(self.block_keys, np.iinfo(np.int64).max)

    def _seek(self, terms: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and item of each list's first posting from item ``least`` on; ``n_items`` at its end."""
        at = np.searchsorted(self.keys, terms * self.n_items + np.minimum(least, self.n_items))
        found = self.keys[at] - terms * self.n_items
        return at, np.where((found < self.n_items) & (terms < len(self.terms)), found, self.n_items)

    def candidates(self, passages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all passages and items whose score reaches the item's threshold, by block-max WAND."""
        known = [[*{self.terms[w] for w in words if w in self.terms}] for words in passages]
        sizes = np.array([len(x) for x in known])
        width = int(sizes.max()) if len(sizes) else 0
        none = np.zeros(0, dtype=np.int64)
        if not width or not len(self.parts):
            return none, none
        terms = np.full((len(known), width), len(self.terms), dtype=np.int64)  # the last term is no term
        terms[np.arange(width)[None, :] < sizes[:, None]] = np.fromiter((t for x in known for t in x), dtype=np.int64, count=int(sizes.sum()))
        rows = np.flatnonzero((self.most[terms].sum(1) >= 1 - 1e-9) & (sizes >= self.least))
        terms = terms[rows]
        at, cursor = self._seek(terms, np.zeros_like(terms))
        found_rows, found_items = [none], [none]
        while len(rows):
            order = np.argsort(cursor, axis=1, kind="stable")
            terms, at, cursor = (np.take_along_axis(x, order, axis=1) for x in (terms, at, cursor))
            bound = np.cumsum(self.most[terms] * (cursor < self.n_items), axis=1)
            kept = (bound[:, -1] >= 1 - 1e-9) & (cursor[:, min(self.least, width) - 1] < self.n_items)
            rows, terms, at, cursor, bound = (x[kept] for x in (rows, terms, at, cursor, bound))
            if not len(rows):
                break
            pivot = np.maximum((bound >= 1 - 1e-9).argmax(1), self.least - 1)
            item = cursor[np.arange(len(rows)), pivot]
            upto = cursor <= item[:, None]
            place = terms * self.n_blocks + (item // BLOCK)[:, None]
            block = np.searchsorted(self.block_keys, place)
            hit = (self.block_keys[block] == place) & upto
            inside = (np.where(hit, self.block_most[np.minimum(block, len(self.block_most) - 1)], 0.0).sum(1) >= 1 - 1e-9) & (hit.sum(1) >= self.least)
            there = inside & (cursor[:, 0] == item)
            if there.any():
                mine = cursor[there] == item[there][:, None]
                score = (np.where(mine, self.parts[np.minimum(at[there], len(self.parts) - 1)], 0.0).sum(1) >= 1 - 1e-9) & (mine.sum(1) >= self.least)
                found_rows.append(rows[there][score])
                found_items.append(item[there][score])
            after = np.where(upto, self.n_items, cursor).min(1)  # the first cursor beyond the pivot
            least = np.where(there, item + 1, np.where(inside, item, np.minimum((item // BLOCK + 1) * BLOCK, after)))
            move = cursor < least[:, None]
            at[move], cursor[move] = self._seek(terms[move], np.broadcast_to(least[:, None], terms.shape)[move])
        return np.concatenate(found_rows), np.concatenate(found_items)

    def passages(self, words: list[str]) -> list[list[str]]:
        """Windows that overlap by ``run`` - 1 words, of the stretches of at least ``run`` words that all occur in items."""
        out = []
        step = WINDOW - self.run + 1
        known = self.terms
        start = 0
        for end in [*[k for k, w in enumerate(words) if w not in known], len(words)]:
            if end - start >= self.run:
                out += [words[i : min(i + WINDOW, end)] for i in range(start, end - self.run + 1, step)]
            start = end + 1
        return out

    def matches(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(text, item) of all that share ``run`` consecutive words."""
        out: set[tuple[int, int]] = set()
        cut = [(n, p) for n, words in enumerate(texts) if len(words) >= self.run for p in self.passages(words)]
        for start in range(0, len(cut), CHUNK):
            part = cut[start : start + CHUNK]
            for passage, item in zip(*map(np.ndarray.tolist, self.candidates([p for _, p in part]))):
                text, words = part[passage]
                if (text, item) not in out and any(" ".join(words[i : i + self.run]) in self.grams[item] for i in range(len(words) - self.run + 1)):
                    out.add((text, item))
        return sorted(out)


_BUILT: dict[tuple, Index] = {}


def _index(key: tuple, rows: list[tuple], run: int) -> Index:
    """The index of a broadcast test set, built once a worker; only the last one is kept."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index([words_of(t) for _, _, t in rows], run)
    return _BUILT[key]


def leaks(training: DataFrame, id_col: str, text_col: str, items: DataFrame, run: int = RUN) -> DataFrame:
    """``id_col, bench, item_id``: training rows and the test items they contain. ``items``: ``bench, item_id, text``."""
    spark = training.sparkSession
    ship(spark)
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    parts = max(1, -(-size // INDEX_WORDS))
    kind = training.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, bench string, item_id long"
    queries = training.select(F.col(id_col), F.col(text_col).alias("text")).where(F.length("text") > 0)
    out = None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("bench", "item_id"), F.lit(parts)) == part).select("bench", "item_id", "text").collect()  # INDEX_WORDS words at most, on average
        shared = spark.sparkContext.broadcast([(r["bench"], r["item_id"], r["text"]) for r in sorted(own, key=lambda r: (r["bench"], r["item_id"]))])

        key = (uuid.uuid4().hex, part)

        def search(batches: Iterator[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            rows = shared.value
            index = _index(key, rows, run)
            for batch in batches:
                found = index.matches([words_of(t) for t in batch.column(1).to_pylist()])
                at = pa.array([a for a, _ in found], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), pa.array([rows[b][0] for _, b in found], type=pa.string()), pa.array([rows[b][1] for _, b in found], type=pa.int64())],
                    names=[id_col, "bench", "item_id"],
                )

        found = queries.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return out.distinct()
